"""Feedback, mining of low scores, readiness and training-data quality (AGG-04/05/09/10/11, STA-04..09, STA-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITIVE, NEGATIVE = ["thumbs_up", "positive"], ["thumbs_down", "negative"]
MIN_COMMENT = 15


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), F.count_if(F.col("rating").isin(POSITIVE)).alias("positive"), F.count_if(F.col("rating").isin(NEGATIVE)).alias("negative")]


def stats(feedback: DataFrame) -> DataFrame:
    rate = F.when(F.col("total") > 0, F.round(100 * F.col("positive") / F.col("total"), 6)).otherwise(F.lit(0.0))
    return feedback.agg(*_counts()).withColumn("rate", rate)


def trace_stats(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("trace_id").agg(*_counts())


def policy(feedback: DataFrame) -> DataFrame:
    """Whether a trace is corrected by itself: a long comment, two negatives, or one negative."""
    by = feedback.groupBy("trace_id").agg(*_counts(), F.max(F.length("comment")).alias("longest"))
    why = F.when(F.coalesce("longest", F.lit(0)) > MIN_COMMENT, "comment").when(F.col("negative") >= 2, "repeated").when(F.col("negative") >= 1, "negative").otherwise("none")
    return by.select("trace_id", why.alias("reason"), (why != "none").alias("correct"))


def low_scores(scores: DataFrame, traces: DataFrame, processed: DataFrame, name: str, below: float, limit: int) -> DataFrame:
    """Traces with a judge score under the bound that were not handled yet, one row each, worst first."""
    rows = scores.filter((F.col("name") == name) & (F.col("value") < below)).join(processed, "trace_id", "left_anti").join(traces, "trace_id")
    worst = Window.partitionBy("trace_id").orderBy("value")
    return rows.withColumn("_n", F.row_number().over(worst)).filter("_n = 1").drop("_n").orderBy("value", "trace_id").limit(limit)


def readiness(rows: DataFrame, as_of: Column) -> DataFrame:
    """Score of 100: 40 for ten samples, 30 for five different questions, 30 for three in the last seven days."""
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("ts")) / 86400)
    got = rows.agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("question").alias("questions"), F.count_if(age <= 7).alias("recent"))
    points = [F.when(F.col(c) >= least, n).otherwise(0) for c, least, n in (("samples", 10, 40), ("questions", 5, 30), ("recent", 3, 30))]
    score = (points[0] + points[1] + points[2]).cast("long")
    return got.withColumn("score", score).withColumn("ready", score >= 70)


def dataset_quality(examples: DataFrame, min_samples: int = 10) -> DataFrame:
    """One row of measures, score and rating for (input, output) examples."""
    a = examples.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("input").alias("unique_inputs"), F.round(F.avg(F.length("input")), 6).alias("avg_input"), F.round(F.avg(F.length("output")), 6).alias("avg_output"),
        F.count_if(F.length("output") < 100).alias("short_outputs"), F.count_if(F.length("output") > 3000).alias("long_outputs"),
    )
    n = F.col("total")
    loss = F.when(n < min_samples, 30).otherwise(0) + F.when(F.col("unique_inputs") / n < 0.8, 20).otherwise(0) + F.when(F.col("short_outputs") > n * 0.3, 15).otherwise(0) + F.when(F.col("long_outputs") > n * 0.2, 10).otherwise(0)
    score = F.when(n == 0, 0).otherwise(100 - loss).cast("long")
    rating = F.when(n == 0, "empty").when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("poor")
    return a.withColumn("score", score).withColumn("rating", rating)


def dedup_examples(rows: DataFrame, order: str) -> DataFrame:
    """First example of each (input, output), by content hash."""
    key = F.md5(F.concat(F.coalesce("input", F.lit("")), F.lit("|||"), F.coalesce("output", F.lit(""))))
    first = Window.partitionBy("key").orderBy(order)
    return rows.withColumn("key", key).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def convert_status(lines: DataFrame) -> DataFrame:
    """valid, invalid (not JSON), incomplete (a field is missing) or duplicate for each non-blank line (n, line)."""
    rows = lines.filter(F.btrim("line") != "").withColumn("j", F.from_json("line", "input string, expectedOutput string, corrected_output string"))
    rows = rows.withColumn("input", F.col("j.input")).withColumn("output", F.coalesce("j.expectedOutput", "j.corrected_output")).withColumn("bad", F.expr("try_parse_json(line)").isNull())
    full = ~F.col("bad") & F.col("input").isNotNull() & F.col("output").isNotNull()
    seen = F.row_number().over(Window.partitionBy(F.when(full, F.md5(F.concat("input", F.lit("|||"), "output"))).otherwise(F.col("n").cast("string"))).orderBy("n"))
    status = F.when(F.col("bad"), "invalid").when(~full, "incomplete").when(seen > 1, "duplicate").otherwise("valid")
    return rows.select("n", status.alias("status"))


def messages_json(pairs: DataFrame, system: str) -> DataFrame:
    """One JSON line a training example (id, input, output)."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return pairs.select("id", F.to_json(F.struct(F.array(message("system", F.lit(system)), message("user", F.col("input")), message("assistant", F.col("output"))).alias("messages"))).alias("line"))
