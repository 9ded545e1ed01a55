"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _toward_smallest(pairs: DataFrame, own: bool) -> DataFrame:
    """Each node's neighbours (with ``own``, the node too) linked to the smallest of them and the node.

    The minimum is a partial aggregate and joins back, so a node with very many neighbours is not one task's work.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = pairs.join(least, "u")
    if own:
        return out.select(F.col("v").alias("a"), "m").unionByName(least.select(F.col("u").alias("a"), "m"))
    return out.filter("v > u").select(F.col("v").alias("a"), "m")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (u, v); component is the smallest node. Unlinked nodes are absent."""
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_smallest(both, own=False).filter("a <> m").distinct().select(F.col("a").alias("u"), F.col("m").alias("v"))
        small = _toward_smallest(large, own=True).filter("a <> m").distinct().select(F.col("a").alias("u"), F.col("m").alias("v"))
        edges = materialize(small)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
