"""Polling into a store (STA-07, STA-11, STA-12) and rows that come too late: micro-batches as numbered commits.

A batch is appended under the name of its query and its number, and such a commit counts once (``operators.transactions``). So a batch that
is run again after a failure, or by a second driver, changes nothing, and a processed set is what the store holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragspark.operators.transactions import TransactionalStore

from .conversations import watermarked


def poll(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start ``run`` on every batch: all there is and no more, or without end a batch ``every`` so often."""
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_batches(store: TransactionalStore, name: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """What appends ``change`` of each batch to a store, once."""

    def run(batch: DataFrame, number: int) -> None:
        store.append(change(batch), name, number)

    return run


def low_scores_once(store: TransactionalStore, name: str, judge: str, below: float) -> Callable[[DataFrame, int], None]:
    """What adds to a store the traces of a batch of scores (trace_id, name, value) whose judge's score is under the bound: the lowest score of each
    trace, and no trace that the store already has."""

    def run(batch: DataFrame, number: int) -> None:
        low = batch.filter((F.col("name") == judge) & (F.col("value") < below) & F.col("trace_id").isNotNull()).groupBy("trace_id").agg(F.min("value").alias("value"))
        if store.versions():
            low = low.join(store.read().select("trace_id"), "trace_id", "left_anti")
        store.append(low.withColumn("batch", F.lit(number).cast("long")), name, number)

    return run


def route_late(on_time: TransactionalStore, late: TransactionalStore, name: str, delay: str, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """What sends each row of a batch to one of two stores: late if it is older than ``delay`` before the newest row of all earlier batches.

    Spark's own windows drop such rows without a word. The bound is read from what the stores hold of earlier batches, so a batch that runs again
    gets the same. Rows without a time are late.
    """

    def run(batch: DataFrame, number: int) -> None:
        newest = None
        if on_time.versions():
            newest = on_time.read().filter(F.col("batch") < number).agg(F.max(ts)).first()[0]  # one row
        early = F.lit(False) if newest is None else F.col(ts) < F.lit(newest) - F.expr(f"interval {delay}")
        rows = batch.withColumn("batch", F.lit(number).cast("long"))
        is_late = F.coalesce(early, F.lit(True)) | F.col(ts).isNull()
        on_time.append(rows.filter(~is_late), name, number)
        late.append(rows.filter(is_late), name, number)

    return run


def sessions(events: DataFrame, by: str, gap: str = "30 minutes", delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(by, start, end, n): runs of events with no ``gap`` between them; a stream emits a session when the watermark has passed its end."""
    if events.isStreaming:
        events = watermarked(events, ts, delay)
    found = events.filter(F.col(ts).isNotNull()).groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
