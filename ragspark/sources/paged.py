"""Paginated listings (SRC-01, SRC-25): numbered pages fetched in tasks, and pages that name their successor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.tables import materialize


def fetch_pages(spark: SparkSession, fetch: Callable[[int], str | None], start: int, last: int, slices: int = 8) -> DataFrame:
    """(page, payload) for pages start..last, both included; a page that fails has a null payload."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = []
            for page in frame["id"].tolist():
                try:
                    got.append(fetch(page))
                except Exception:  # a failed page ends the listing, as an empty one does
                    got.append(None)
            yield pd.DataFrame({"page": frame["id"], "payload": pd.Series(got, dtype=object)})

    return spark.range(start, last + 1, 1, slices).mapInPandas(run, "page long, payload string")


def items_of_pages(pages: DataFrame) -> DataFrame:
    """(page, pos, item) of the JSON arrays before the first page that is empty, broken or null."""
    rows = pages.select("page", F.from_json("payload", "array<string>").alias("items"))
    # One row: the end of the listing.
    end = rows.filter(F.coalesce(F.size("items"), F.lit(0)) <= 0).agg(F.min("page").alias("end"))
    rows = rows.join(F.broadcast(end)).filter(F.col("end").isNull() | (F.col("page") < F.col("end")))
    return rows.select("page", F.posexplode("items").alias("pos", "item"))


def follow_links(pages: DataFrame, first: str) -> DataFrame:
    """(n, address, payload): the pages (address, payload, next) from ``first`` on, each found by the one before, to the end.

    The walk ends at a null or unknown address or at a page met before. Pointer doubling: after k rounds the first 2**k
    pages have their place and every page knows the one 2**k on, so a listing takes as many joins as its length has bits.
    Of rows with one address the one with the smallest (next, payload) counts, nulls first.
    """
    one = F.min(F.struct("next", "payload")).alias("p")
    rows = pages.filter(F.col("address").isNotNull()).groupBy("address").agg(one).select("address", "p.payload", "p.next")
    known = rows.select(F.col("address").alias("next"))
    # A page that leads to none keeps a null.
    jump = materialize(rows.select("address", "next").join(known, "next", "left_semi").select("address", "next"))
    placed = materialize(rows.filter(F.col("address") == first).select("address", F.lit(1).cast("long").alias("n")))
    step, found = 1, placed.count()
    while found:
        ahead = placed.join(jump, "address").select(F.col("next").alias("address"), (F.col("n") + step).alias("n"))
        # In a cycle pages are met again: the first place counts.
        placed = materialize(placed.unionByName(ahead).groupBy("address").agg(F.min("n").alias("n")))
        now = placed.count()
        if now < 2 * found:
            break
        found, step = now, 2 * step
        on = jump.select(F.col("address").alias("next"), F.col("next").alias("then"))
        jump = materialize(jump.join(on, "next").select("address", F.col("then").alias("next")))
    return rows.join(placed, "address").select(F.col("n").cast("int").alias("n"), "address", "payload")
