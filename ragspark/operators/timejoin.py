"""Joins by time: the newest row before a moment, and all rows within a span of it.

One key may hold a third of all rows, so no task gets a whole key: time is cut into buckets.

* As-of: both sides are put into one frame and sorted within (key, bucket); a row takes the last value before it, and the first rows of a bucket take
  what the earlier buckets left over, one row a bucket.
* Interval: a row of the left goes to the buckets that its span touches, where an equi-join by (key, bucket) meets the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket.
BUCKET = 86_400


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], tie: str, tolerance: float | None = None, bucket: int = BUCKET) -> DataFrame:
    """``left`` with ``values`` of the newest row of ``right`` that has its keys and is not after it; nulls where there is none.

    Of right rows of one time the largest ``tie`` counts. ``tolerance``: seconds beyond which a row is too old. Rows of the left are kept, repeated ones
    too; those with a null key or time get nulls.
    """
    found = F.struct(*[F.col(v) for v in values]).alias("_found")
    keys = [F.col(b) for b in by]
    a = left.select(F.struct(*left.columns).alias("_left"), *keys, _micros(on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"))
    b = right.filter(F.col(on).isNotNull()).select(*keys, _micros(on).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(_micros(on).alias("at"), found).alias("_value"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_at") / (bucket * 1_000_000)))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_at", "_side", "_tie")
    both = both.withColumn("_value", F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    newest = b.withColumn("_bucket", F.floor(F.col("_at") / (bucket * 1_000_000))).groupBy(*by, "_bucket").agg(F.max_by("_value", F.struct("_at", "_tie")).alias("_last"))
    # One row for each bucket that has rows; a bucket takes over from the last one before it that has right rows.
    slots = both.select(*by, "_bucket").distinct().join(newest, [*by, "_bucket"], "left")
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*by, "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    rows = both.filter("_side = 1")
    same = [rows[c].eqNullSafe(slots[c]) for c in [*by, "_bucket"]]
    on_ = same[0]
    for s in same[1:]:
        on_ &= s
    rows = rows.join(slots, on_, "left").select("_left", rows["_at"], F.coalesce("_value", "_carried").alias("_value"), *[rows[b].isNotNull().alias(f"_has_{i}") for i, b in enumerate(by)])
    ok = F.col("_at").isNotNull()
    for i in range(len(by)):
        ok &= F.col(f"_has_{i}")
    if tolerance is not None:
        ok &= F.col("_at") - F.col("_value.at") <= F.lit(int(tolerance * 1_000_000))
    return rows.select("_left.*", *[F.when(ok, F.col(f"_value._found.{v}")).alias(v) for v in values])


def interval_join(left: DataFrame, right: DataFrame, on: str, by: str, before: float, after: float) -> DataFrame:
    """Pairs as (l, r) structs: rows with equal ``by`` where the right's time is from ``before`` seconds before the left's to ``after`` seconds after it, both included."""
    lo, hi = int(before * 1_000_000), int(after * 1_000_000)
    width = max(1, lo + hi)
    at = _micros(on)
    spans = F.sequence(F.floor((at - lo) / width), F.floor((at + hi) / width))
    a = left.filter(F.col(on).isNotNull()).select(F.struct(*left.columns).alias("l"), F.col(by).alias("_by"), at.alias("_at"), F.explode(spans).alias("_bucket"))
    b = right.filter(F.col(on).isNotNull()).select(F.struct(*right.columns).alias("r"), F.col(by).alias("_by2"), at.alias("_at2"), F.floor(at / width).alias("_bucket2"))
    met = (F.col("_by") == F.col("_by2")) & (F.col("_bucket") == F.col("_bucket2")) & F.col("_at2").between(F.col("_at") - lo, F.col("_at") + hi)
    return a.join(b, met).select("l", "r")
