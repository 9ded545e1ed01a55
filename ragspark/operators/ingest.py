"""Storing files one by one in effect and all at once in work (SNK-07), stored maps (AGG-02, SCA-14)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.tables import discard, materialize

from .transactions import TransactionalStore


def embed_safely(embed: Callable[[str], list[float]]) -> Callable[[Column], Column]:
    """What gives (embedding, error) for each text: a text that can't be embedded has an error and stops nothing else."""

    @F.pandas_udf("embedding array<double>, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        def one(text: str | None) -> tuple:
            try:
                if text is None:
                    raise ValueError("no text")
                return [float(x) for x in embed(text)], None
            except Exception as e:  # told with its file
                return None, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(t) for t in texts], columns=["embedding", "error"])

    return run


def store_files(table: TransactionalStore, chunks: DataFrame, embed: Callable[[str], list[float]], file: str = "file_name", writer: str | None = None, batch: int | None = None) -> DataFrame:
    """(file, n_chunks, status, error): chunks (file, text, ...) put into a store file by file.

    The chunks of a file replace its old ones, if all of them could be embedded; else the file has status failed with its first error, and its
    old chunks stay. Files do not wait for each other's failures: all good ones are stored by one commit. Chunks without a file are of ``unknown``.
    """
    name = F.coalesce(F.nullif(F.col(file), F.lit("")), F.lit("unknown"))
    made = materialize(chunks.withColumn(file, name).withColumn("_made", embed_safely(embed)(F.col("text"))).select(*chunks.columns, F.col("_made.embedding").alias("embedding"), F.col("_made.error").alias("_error")))
    status = F.when(F.count("_error") > 0, "failed").otherwise("stored").alias("status")
    log = materialize(made.groupBy(file).agg(F.count(F.lit(1)).alias("n_chunks"), status, F.min("_error").alias("error")))
    good = log.filter("status = 'stored'").select(file)
    new = made.join(good, file, "left_semi").select(*chunks.columns, "embedding")
    if table.versions():
        table.update(lambda old: old.join(good, file, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True), None, writer, batch)
    else:
        table.append(new, writer, batch)
    discard(made)
    return log


def get_or(values: Column, key: Column, default: Column) -> Column:
    """A map's value; the default if the map is null or lacks the key. A null value stays."""
    return F.when(F.coalesce(F.map_contains_key(values, key), F.lit(False)), F.try_element_at(values, key)).otherwise(default)


def merged(first: Column, then: Column) -> Column:
    """Both maps' entries, the later map's where both have the key, under any setting of the session; null maps are empty."""
    left = F.filter(F.map_entries(first), lambda e: ~F.coalesce(F.map_contains_key(then, e["key"]), F.lit(False)))
    entries = F.when(first.isNull(), F.map_entries(then)).when(then.isNull(), F.map_entries(first)).otherwise(F.concat(left, F.map_entries(then)))
    return F.map_from_entries(entries)


def stored_conversations(maps: DataFrame, payload: str = "payload") -> DataFrame:
    """One row (n_users, n_messages) over JSON objects keyed by user, each value with its ``messages``; a user without any counts."""
    users = maps.select(F.explode(F.from_json(payload, "map<string,struct<messages:array<string>>>")).alias("user", "value"))
    return users.agg(F.count(F.lit(1)).alias("n_users"), F.coalesce(F.sum(F.coalesce(F.array_size("value.messages"), F.lit(0))), F.lit(0)).cast("long").alias("n_messages"))
