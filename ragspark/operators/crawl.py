"""Link-graph and folder walks as breadth-first joins (SRC-20, SRC-26..29) and file eligibility (SRC-21/22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUPPORTED = ["pdf", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "txt", "md"]
MAX_BYTES = 50 * 1024 * 1024


def walk(edges: DataFrame, roots: DataFrame, max_depth: int = 3, max_children: int | None = None) -> DataFrame:
    """(node, depth): nodes reached from roots (node), at their smallest depth. One join and one anti-join a level."""
    if max_children:
        order = Window.partitionBy("src").orderBy("dst")
        edges = edges.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_children).drop("_n")
    seen = roots.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
    return seen


def eligible(items: DataFrame) -> DataFrame:
    """Files (name, size, url) of a supported type and size, the first of each url, with their metadata."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    rows = items.withColumn("file_type", ext).filter(F.col("file_type").isin(SUPPORTED) & (F.col("size") <= MAX_BYTES))
    first = Window.partitionBy("url").orderBy("name")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").withColumn("file_size_kb", F.bround(F.col("size") / 1024, 2))
