"""Curation of training data (SRC-35..39, SNK-11, SNK-15, AGG-09..11, STA-05..10, STA-19, STA-20): formats, mining, totals, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import feedback

BLANKS = " \t\n\x0b\x0c\r"
#: The judge's score name, samples below which a run needs confirmation, and fetch limits of a mining run.
JUDGE = "response_quality_judge"
MIN_SAMPLES = 50
MAX_SCORES, MAX_TRACES = 100, 20
RATINGS = {"thumbs_up": 1, "thumbs_down": 0}


def meeting_id(body: Column) -> Column:
    """The token after the first ``MSo``, up to white space or a comma; null without one."""
    return F.nullif(F.regexp_extract(body, r"MSo\s*([^\s,]+)", 1), F.lit(""))


def line_format(line: Column) -> Column:
    """exported (input and expectedOutput), standard (input and corrected_output) or unknown."""
    keys = F.json_object_keys(line)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    return F.when(has("input") & has("expectedOutput"), "exported").when(has("input") & has("corrected_output"), "standard").otherwise("unknown")


def file_format(lines: DataFrame) -> DataFrame:
    """(file, format) by the first line of each file (file, n, line)."""
    first = F.btrim(F.min_by("line", "n"), F.lit(BLANKS))
    return lines.groupBy("file").agg(first.alias("line")).select("file", line_format(F.col("line")).alias("format"))


def convert(lines: DataFrame) -> DataFrame:
    """(n, input, output, status) of non-blank lines of either format; see ``feedback.convert_status``."""
    rows = lines.filter(F.btrim("line", F.lit(BLANKS)) != "").withColumn("j", F.from_json("line", "input string, expectedOutput string, corrected_output string"))
    fields = rows.select("n", F.col("j.input").alias("input"), F.coalesce("j.expectedOutput", "j.corrected_output").alias("output"))
    return feedback.convert_status(lines).join(fields, "n").select("n", "input", "output", "status")


def convert_totals(status: DataFrame) -> DataFrame:
    """Counts by status over the non-blank lines and the share of valid ones in percent (0 without lines)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("valid", "duplicate", "invalid", "incomplete")]
    rate = F.when(F.col("total") > 0, F.round(100 * F.col("valid") / F.col("total"), 4)).otherwise(F.lit(0.0))
    return status.agg(F.count(F.lit(1)).alias("total"), *counts).withColumn("success_percent", rate)


def union_corrections(unified: DataFrame, daily: DataFrame) -> DataFrame:
    """Examples (id, input, output) of the unified file and then of the daily ones, the first of each content."""
    rows = unified.select(F.lit(0).alias("part"), "id", "input", "output").unionByName(daily.select(F.lit(1).alias("part"), "id", "input", "output"))
    key = F.md5(F.concat(F.coalesce("input", F.lit("")), F.lit("|||"), F.coalesce("output", F.lit(""))))
    first = Window.partitionBy(key).orderBy("part", "id")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def quality_report(examples: DataFrame, min_samples: int = 10) -> DataFrame:
    """``feedback.dataset_quality`` with length ranges, diversity and the issues found."""
    lengths = examples.agg(*[f(F.length(c)).alias(f"{n}_{c}") for c in ("input", "output") for n, f in (("min", F.min), ("max", F.max))])
    # Both sides are one row.
    q = feedback.dataset_quality(examples, min_samples).join(F.broadcast(lengths))
    n, share = F.col("total"), F.col("unique_inputs") / F.col("total")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    issues = F.array_compact(F.array(
        F.when(n < min_samples, text("Small dataset size (", n.cast("string"), f" < {min_samples})")), F.when(share < 0.8, text("Low input diversity (", F.format_string("%.1f", share * 100), "%)")),
        F.when(F.col("short_outputs") > n * 0.3, text("Many short outputs (", F.col("short_outputs").cast("string"), " < 100 chars)")), F.when(F.col("long_outputs") > n * 0.2, text("Many very long outputs (", F.col("long_outputs").cast("string"), " > 3000 chars)")),
    ))
    return q.withColumn("diversity", F.when(n > 0, F.round(share, 6)).otherwise(F.lit(0.0))).withColumn("issues", F.when(n > 0, issues).otherwise(F.array().cast("array<string>")))


def quality_gate(quality: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Adds needs_confirmation, for small sets, and passes: not poor or empty, and nothing to confirm."""
    small = F.col("total") < min_samples
    return quality.withColumn("needs_confirmation", small).withColumn("passes", ~small & ~F.col("rating").isin("poor", "empty"))


def recommendations(ready: DataFrame) -> DataFrame:
    """Adds what is missing to a row of ``feedback.readiness``."""
    need = F.when(F.col("samples") < 10, F.concat(F.lit("Need "), (10 - F.col("samples")).cast("string"), F.lit(" more samples")))
    more = F.when(F.col("questions") < 5, F.lit("Need more diverse question types"))
    recent = F.when(F.col("recent") < 3, F.lit("Need more recent feedback data"))
    return ready.withColumn("recommendations", F.array_compact(F.array(need, more, recent)))


def rating_value(rating: Column) -> Column:
    """1 for a thumb up, 0 for a thumb down; null for what is no rating."""
    return F.when(rating.isin(*RATINGS), (rating == "thumbs_up").cast("int"))


def record_feedback(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(score rows trace_id, name, value, comment; rejected requests) of requests (trace_id, rating, comment)."""
    valid = F.coalesce(rating_value(F.col("rating")).isNotNull(), F.lit(False))
    good = requests.filter(valid).select("trace_id", F.lit("user_feedback").alias("name"), rating_value(F.col("rating")).cast("double").alias("value"), "comment")
    return good, requests.filter(~valid)


def appended(store: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Inserts stamped with the time of the insert."""
    return store.unionByName(new.withColumn("created_at", as_of), allowMissingColumns=True)


def capture(corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The correction rows and the corrected-response rows of one frame (trace_id, question, bad_response, corrected, comment)."""
    a = corrections.select("trace_id", F.col("question").alias("input"), F.col("bad_response").alias("bad_output"), F.col("corrected").alias("corrected_output"), "comment")
    b = corrections.select("trace_id", F.col("question").alias("original_question"), F.col("corrected").alias("response"), F.lit("auto_corrected").alias("status"))
    return a, b


def named_scores(scores: DataFrame, name: str = JUDGE, limit: int = 10) -> DataFrame:
    """The newest scores of one name (name, value, trace_id, ts), at most min(3 * limit, MAX_SCORES): what one fetch may bring."""
    return scores.filter(F.col("name") == name).orderBy(F.desc("ts"), "trace_id").limit(min(3 * limit, MAX_SCORES))


def mine_traces(traces: DataFrame, processed: DataFrame, below: float, limit: int, tag: str = "chat", name: str = JUDGE) -> DataFrame:
    """(trace_id, value) mined from the newest min(2 * limit, MAX_TRACES) traces (trace_id, ts, tags, scores) of a tag: the lowest judge score under the bound, one row a trace."""
    newest = traces.filter(F.array_contains("tags", tag)).orderBy(F.desc("ts"), "trace_id").limit(min(2 * limit, MAX_TRACES))
    low = newest.join(processed.select("trace_id").distinct(), "trace_id", "left_anti").select("trace_id", F.explode("scores").alias("s")).filter((F.col("s.name") == name) & (F.col("s.value") < below))
    return low.groupBy("trace_id").agg(F.min("s.value").alias("value")).orderBy("value", "trace_id").limit(limit)


def batch_outcome(traces: DataFrame) -> DataFrame:
    """Adds outcome to traces (id, input, output, corrected): failed (no input or output), processed, or logged if a correction came."""
    full = (F.coalesce("input", F.lit("")) != "") & (F.coalesce("output", F.lit("")) != "")
    return traces.withColumn("outcome", F.when(~full, "failed").when(F.col("corrected").isNotNull(), "logged").otherwise("processed"))


def trace_log(traces: DataFrame, observations: DataFrame, scores: DataFrame) -> DataFrame:
    """Each trace with the number of its observations and its scores as an array of (name, value), sorted."""
    seen = observations.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_observations"))
    judged = scores.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("scores"))
    rows = traces.join(seen, "trace_id", "left").join(judged, "trace_id", "left")
    return rows.withColumn("n_observations", F.coalesce("n_observations", F.lit(0).cast("long"))).withColumn("scores", F.coalesce("scores", F.array().cast("array<struct<name:string,value:double>>")))


def selected(rows: DataFrame, **values) -> DataFrame:
    """Rows whose columns have the given values, null included; the read-side filters."""
    for c, v in values.items():
        rows = rows.filter(F.col(c).eqNullSafe(F.lit(v)))
    return rows


def write_training_file(pairs: DataFrame, system: str, path: str) -> None:
    """JSON lines of chat examples (id, input, output) under ``path``, in as many files as there are partitions."""
    feedback.messages_json(pairs, system).select("line").write.mode("overwrite").text(path)
