"""Conversation windows as list state (STA-02): the last messages of each conversation, kept by ``transformWithStateInPandas``.

Each message is one element of a list state, with a time to live, so a conversation nobody returns to costs nothing in the end; a timer closes
one that was silent for a while and says so. State is in RocksDB and goes with the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

KEPT = 20
#: Milliseconds: silence after which a conversation is closed, and life of a message.
IDLE, LIFE = 30 * 60 * 1000, 30 * 24 * 60 * 60 * 1000
_MESSAGE = "turn long, role string, text string"
_OUT = "conv_id long, event string, turn long, role string, text string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastMessages(StatefulProcessor):
    """Keeps the ``kept`` messages of the highest turns, equal ones once; emits the window of each changed conversation, or that it was closed."""

    def __init__(self, kept: int = KEPT, idle: int = IDLE, life: int = LIFE):
        self.kept, self.idle, self.life = kept, idle, life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", _MESSAGE, self.life)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = {tuple(m) for m in self.messages.get()}
        for frame in rows:
            kept |= {(int(t), r, x) for t, r, x in zip(frame["turn"], frame["role"], frame["text"], strict=True)}
            # Never more than one batch beyond what is kept.
            kept = set(sorted(kept, key=lambda m: (m[0], str(m[1]), str(m[2])))[-self.kept :])
        window = sorted(kept, key=lambda m: (m[0], str(m[1]), str(m[2])))
        self.messages.put(window)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self._out(key[0], "window", window)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.messages.clear()
        yield self._out(key[0], "closed", [(None, None, None)])

    def close(self) -> None:
        pass

    @staticmethod
    def _out(conv_id: int, event: str, messages: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(conv_id, event, *m) for m in messages], columns=["conv_id", "event", "turn", "role", "text"])
        return out.astype({"turn": "Int64"})


def last_messages(turns: DataFrame, kept: int = KEPT, idle: int = IDLE, life: int = LIFE) -> DataFrame:
    """(conv_id, event, turn, role, text) of a stream of turns: the whole window of every conversation that a batch changed."""
    return turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").transformWithStateInPandas(LastMessages(kept, idle, life), _OUT, "update", "ProcessingTime")


def start(windows: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """``run`` on every batch of windows: of all that has arrived, or without end ``every`` so often.

    Timers by the clock ask for another batch for ever, so a query that is to end has no batches without data: its timers go off with the next data.
    """
    conf = windows.sparkSession.conf
    wanted = {"spark.sql.streaming.stateStore.providerClass": _PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "true" if every else "false"}
    before = {name: conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            conf.set(name, value)
        # A query keeps the settings that it is started with.
        writer = windows.writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
