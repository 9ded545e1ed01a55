"""Polls as mergeable sketches (AGG-06, AGG-15): what was counted need not be read again to count over several polls.

Each poll of a collection leaves one row: an exact count, HyperLogLog and theta sketches of the ids, a KLL sketch of the values. Merging polls merges rows.
Bounds, in standard deviations: distinct ids 1.6 % (HyperLogLog), 1.6 % of the union for differences (theta); a quantile's rank 1.4 % (KLL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: log2 of registers and of entries: 2**12 give 1 / sqrt(4096) = 1.6 %.
LOG_SIZE = 12
ID_ERROR, RANK_ERROR = 0.016, 0.014


def polled(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """A row of sketches for each poll and collection (``by``)."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(key, F.lit(LOG_SIZE)).alias("ids"),
        F.theta_sketch_agg(key, F.lit(LOG_SIZE)).alias("id_set"),
        F.kll_sketch_agg_double(F.col(value).cast("double")).alias("values"),
    )


def merged(polls: DataFrame, by: list[str]) -> DataFrame:
    """The same over all polls of a coarser grouping."""
    return polls.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("ids").alias("ids"),
        F.theta_union_agg("id_set", F.lit(LOG_SIZE)).alias("id_set"),
        F.kll_merge_agg_double("values").alias("values"),
    )


def n_ids(sketch: str = "ids") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(rank: float, sketch: str = "values") -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(rank))


def changes(polls: DataFrame, by: list[str], poll: str) -> DataFrame:
    """Adds n_new and n_gone: ids of a poll that the one before did not have, and the other way round; null at a collection's first."""
    before = F.lag("id_set").over(Window.partitionBy(*by).orderBy(poll))
    rows = polls.withColumn("_before", before)
    less = lambda a, b: F.theta_sketch_estimate(F.theta_difference(a, b))
    return rows.withColumn("n_new", less(F.col("id_set"), F.col("_before"))).withColumn("n_gone", less(F.col("_before"), F.col("id_set"))).drop("_before")
