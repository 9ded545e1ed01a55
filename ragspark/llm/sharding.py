"""Operator 9, sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id, row number), so equal texts are neighbours. Splitters of that order are
found by counting, in rounds, the exact bytes and rows below candidate boundaries over all partitions and
probing finer only inside the interval that holds each target; at a text's edge if one is within tolerance,
else inside the group, by doc_id, and among rows equal in both by row number, all such groups in the same rounds. Then rows are exchanged once, into buckets of whole key ranges.

The law is ``bytes``: shards of near equal size. What reaches the driver is one row a probe interval,
whose number depends on the shard count alone. Rounds end when every splitter is within ``tolerance``
of its target or can't be refined.

Defined cases: null text has size 1 and crc of the empty text; equal rows are kept and may lie in several shards, as any
group of equal texts may that is too large for one; a null doc_id sorts first in its group; an empty table gives an empty table; fewer rows than shards leaves shards empty.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

N_SHARDS = 8
#: Allowed distance of a splitter from its target, as a share of a shard.
TOLERANCE = 0.002
#: Below every document's key.
_LOW = -(2**63)
#: A round divides an open interval by this many equally spaced probes.
PROBES = 64


class _Interval(NamedTuple):
    """Values [lo, hi) of a column, within one group or in all rows, the bytes below either end, and whether it holds more than one row."""

    group: int | None
    lo: int
    hi: int
    below: float
    upto: float
    several: bool = True


def _search(rows: DataFrame, column: str, spans: list[_Interval], targets: list[float], slack: float, group: str | None = None) -> list[_Interval]:
    """Narrow each interval around its target, all of them in the same rounds.

    A round is one aggregation: exact bytes in every cell of the intervals that are still open. An interval
    is closed when it is one value wide, holds one row, or has an end within slack of the target.
    """
    spans, probes = list(spans), PROBES * (1 if group else max(len(targets), 1))
    while True:
        open_ = {s for s, t in zip(spans, targets, strict=True) if s.several and s.hi - s.lo > 1 and min(t - s.below, s.upto - t) > slack}
        if not open_:
            return spans
        # A power of two, so that the cells of a round lie within those of the rounds before and none straddles two intervals.
        width = 1 << (-(-max(s.hi - s.lo for s in open_) // probes) - 1).bit_length()
        probes = PROBES
        inside = F.lit(False)
        for s in sorted(open_):
            part = (F.col(column) >= F.lit(s.lo)) & (F.col(column) <= F.lit(s.hi - 1))
            inside |= part & (F.col(group) == F.lit(s.group)) if group else part
        # in decimals: no overflow for the full range of longs
        cell = F.floor(F.col(column).cast("decimal(20,0)") / F.lit(width).cast("decimal(20,0)")) if width > 1 else F.col(column)
        of = F.col(group) if group else F.lit(None).cast("long")
        got: dict[int | None, dict[int, tuple[int, int]]] = {}
        for r in rows.filter(inside).groupBy(of.alias("of"), cell.alias("cell")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
            got.setdefault(r["of"], {})[int(r["cell"])] = r["b"], r["n"]
        for i, (s, t) in enumerate(zip(spans, targets, strict=True)):
            if s not in open_:
                continue
            left, found, cells = s.below, None, got.get(s.group, {})
            for c in sorted(k for k in cells if s.lo <= max(k * width, s.lo) < s.hi and (k + 1) * width > s.lo):
                size, n = cells[c]
                if left + size > t:
                    found = _Interval(s.group, max(c * width, s.lo), min((c + 1) * width, s.hi), left, left + size, n > 1)
                    break
                left += size
            spans[i] = found or _Interval(s.group, s.hi - 1, s.hi, s.upto, s.upto)


def splitters(rows: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int, int]]:
    """Lowest keys (h, k, u) of the shards after the first. ``rows`` has h, k, u, size."""
    total, low, high = rows.agg(F.sum("size"), F.min("h"), F.max("h")).first()
    if not total:
        return []
    slack = tolerance * total / n_shards
    targets = [total * i / n_shards for i in range(1, n_shards)]
    out, hot = [], []
    for target, s in zip(targets, _search(rows, "h", [_Interval(None, low, high + 1, 0, total)] * len(targets), targets, slack), strict=True):
        if not s.several or s.hi - s.lo > 1 or min(target - s.below, s.upto - target) <= slack:
            out.append((s.lo if target - s.below <= s.upto - target else s.hi, _LOW, _LOW))
        else:  # the target lies inside a group of equal texts that is larger than the slack
            hot.append((target, (s.lo,), s))
    # Inside equal texts by doc_id, and inside rows that are equal in both by the number of the row.
    for column, rest in (("k", (_LOW,)), ("u", ())):
        if not hot:
            break
        # One group a splitter at most.
        keys = sorted({key for _, key, _ in hot})
        group = F.lit(None).cast("long")
        for i, key in enumerate(keys):
            same = F.col("h") == F.lit(key[0])
            group = F.when(same & (F.col("k") == F.lit(key[1])) if len(key) > 1 else same, F.lit(i).cast("long")).otherwise(group)
        within = rows.withColumn("group", group).filter(F.col("group").isNotNull())
        ends = {r["group"]: r for r in within.groupBy("group").agg(F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        spans = [_Interval(i, ends[i]["lo"], ends[i]["hi"] + 1, s.below, s.upto) for i, s in ((keys.index(key), s) for _, key, s in hot)]
        deeper = []
        for (target, key, _), s in zip(hot, _search(within, column, spans, [t for t, _, _ in hot], slack, "group"), strict=True):
            if rest and s.several and s.hi - s.lo == 1 and min(target - s.below, s.upto - target) > slack:
                deeper.append((target, (*key, s.lo), s))
            else:
                out.append((*key, s.lo if target - s.below <= s.upto - target else s.hi, *rest))
        hot = deeper
    return sorted(out)


def shard(docs: DataFrame, n_shards: int = N_SHARDS, buckets_per_shard: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW + 1)).alias("k"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    # Numbers are written once, so that all rounds see the same.
    rows = materialize(rows.withColumn("u", F.monotonically_increasing_id()))
    cuts = splitters(rows, n_shards * buckets_per_shard, tolerance)
    where = F.lit(0)
    if cuts:
        keys = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(k).alias("k"), F.lit(u).cast("long").alias("u")) for h, k, u in cuts])
        where = F.size(F.filter(keys, lambda x: x <= F.struct(F.col("h"), F.col("k"), F.col("u"))))
    rows = rows.withColumn("bucket", where)
    # One row a bucket; their number depends on the shard count alone.
    counts = {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, begun = {}, 0
    for b in range(n_shards * buckets_per_shard):
        begun = 0 if b % buckets_per_shard == 0 else begun
        start[b] = begun
        begun += counts.get(b, 0)
    sizes = rows.sparkSession.createDataFrame([(b, n) for b, n in start.items()], "bucket int, start long")
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy("h", "k", "u")) - 1)
    return placed.join(F.broadcast(sizes), "bucket").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("bucket") / buckets_per_shard).cast("int").alias("shard"),
        (F.col("start") + F.col("at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
