"""Conversation state (WIN-01/02, STA-01..03, AGG-01..03) over one row per turn: (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_messages(turns: DataFrame, n: int = 20, key: str = "conv_id", order: str = "turn") -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return turns.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")


def context(turns: DataFrame, n: int = 5, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The prompt text of each conversation's last n messages."""
    speaker = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    line = F.concat(speaker, F.lit(": "), F.col("text"), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    text = F.concat(F.lit("\n\nPrevious conversation:\n"), F.array_join(F.transform(rows, lambda x: x["l"]), ""))
    return last_messages(turns, n, key, order).groupBy(key).agg(text.alias("context"))


def stats(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    return turns.agg(F.count_distinct(key).alias("n_users"), F.count(F.lit(1)).alias("n_messages"))


def get_or_create(users: DataFrame, turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Every user with the number of messages kept; a new user has none."""
    counts = turns.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return users.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_messages"), F.col("n").isNull().alias("is_new"))


def append(turns: DataFrame, new: DataFrame, n: int = 20, key: str = "conv_id", order: str = "turn") -> DataFrame:
    return last_messages(turns.unionByName(new), n, key, order)


def clear(turns: DataFrame, keys: DataFrame, key: str = "conv_id") -> DataFrame:
    return turns.join(keys, key, "left_anti")
