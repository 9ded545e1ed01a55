"""Streams (STA-02, STA-11..13): conversation windows and monitors as Structured Streaming queries; see also ``messages`` and ``polling``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEPT = 20
_STATE = "turns array<bigint>, roles array<string>, texts array<string>"
_OUT = "conv_id long, n_kept int, first_turn long, last_turn long"


def _keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = list(zip(*map(list, state.get), strict=True)) if state.exists else []
    for batch in batches:
        rows += list(zip(batch["turn"], batch["role"], batch["text"], strict=True))
        rows = sorted(rows, key=lambda r: r[0])[-KEPT:]
    state.update(tuple(map(list, zip(*rows, strict=True))))
    yield pd.DataFrame([(key[0], len(rows), int(rows[0][0]), int(rows[-1][0]))], columns=["conv_id", "n_kept", "first_turn", "last_turn"])


def keep_last(turns: DataFrame) -> DataFrame:
    """Per conversation, the last KEPT messages as state; emits the window of each changed conversation."""
    return turns.groupBy("conv_id").applyInPandasWithState(_keep, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def watermarked(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks are of time stamps with a zone only; those without are taken in the session's."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def new_traces(traces: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each trace once, within the watermark: the processed set of a polling loop."""
    return watermarked(traces, "ts", delay).dropDuplicatesWithinWatermark(["trace_id"])


def live_counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Extension: tumbling windows with late data up to ``delay``."""
    return watermarked(events, "ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def parse_progress(messages: DataFrame) -> DataFrame:
    """Adds step, total and loss, read from a job's messages; null where a message has none."""
    number = lambda pattern, kind: F.nullif(F.regexp_extract("message", pattern, 1), F.lit("")).cast(kind)
    return messages.withColumn("step", number(r"(?i)step\s+(\d+)\s*/", "int")).withColumn("total", number(r"(?i)step\s+\d+\s*/\s*(\d+)", "int")).withColumn("loss", number(r"(?i)loss\s*[=:]\s*([0-9.]+)", "double"))


def job_progress(events: DataFrame, since: str, delay: str = "10 minutes") -> DataFrame:
    """Furthest step and least loss of each job (job_id, ts, message) from events newer than ``since``; the step never falls."""
    newer = watermarked(parse_progress(events.filter(F.col("ts") > F.lit(since).cast("timestamp"))), "ts", delay)
    return newer.groupBy("job_id").agg(F.max("step").alias("step"), F.max("total").alias("total"), F.min("loss").alias("loss"))
