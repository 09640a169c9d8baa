"""Queues whose consumers and controls are events of the same stream: transformWithState with a list and two values a key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that lists and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def list_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in the store that has lists and timers."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class QueueProcessor(StatefulProcessor):
    """FIFO of a key: put, take, clear and close, by order within a trigger.

    A take of an empty queue waits for the next put while the queue is open, and gets nothing once it is closed. Closing
    keeps what is there for later takes. With `idle`, a queue that gets no event for so many milliseconds of event time is
    closed by a timer.
    """

    def __init__(self, key: str, idle: int | None = None):
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "item long")
        self.state = handle.getValueState("state", "taken long, waiting long, closed boolean")

    def _load(self) -> tuple[list[int], int, int, bool]:
        taken, waiting, closed = self.state.get() if self.state.exists() else (0, 0, False)
        return [int(r[0]) for r in self.held.get()] if self.held.exists() else [], int(taken), int(waiting), bool(closed)

    def _store(self, held: list[int], taken: int, waiting: int, closed: bool) -> None:
        self.state.update((taken, waiting, closed))
        if held:
            self.held.put([(i,) for i in held])
        else:
            self.held.clear()

    def _row(self, key: tuple, held: list[int], taken: int, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "taken": [taken], "left": [len(held)], "closed": [closed]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held, taken, waiting, closed = self._load()
        latest = None
        for order, kind, *at in self._sorted(rows):
            latest = max(latest, at[0]) if at and latest is not None else at[0] if at else None
            if kind == "put":
                if waiting:
                    waiting, taken = waiting - 1, taken + 1
                else:
                    held.append(int(order))
            elif kind == "take":
                if held:
                    held.pop(0)
                    taken += 1
                elif not closed:
                    waiting += 1
            elif kind == "clear":
                held = []
            elif kind == "close":
                closed, waiting = True, 0  # those that wait get nothing
        if self.idle is not None and latest is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(pd.Timestamp(latest).timestamp() * 1000) + self.idle)
        self._store(held, taken, waiting, closed)
        yield self._row(key, held, taken, closed)

    @staticmethod
    def _sorted(rows: Iterator[pd.DataFrame]) -> list[tuple]:
        """(order, kind[, time]) by order; by place, since computed columns come without their names."""
        return sorted(t for pdf in rows for t in pdf.iloc[:, 1:].itertuples(index=False, name=None))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        held, taken, _, _ = self._load()
        self._store(held, taken, 0, True)
        yield self._row(key, held, taken, True)

    def close(self) -> None:
        pass


def consumed_queue(stream: DataFrame, key: str, order: str, kind: Column, idle: int | None = None, time: str | None = None) -> DataFrame:
    """(key, taken, left, closed) after each trigger, of a queue a key with consumers and controls.

    `kind` says what an event does: put, take, clear or close; anything else, and null, nothing. `time` is the column with
    the watermark, for `idle`. A queue holds what was put and not yet taken. Start it within `list_state`. A batch that is
    run again gives the same rows, since state is kept by version.
    """
    kinds = dict(stream.dtypes)
    rows = stream.select(key, order, F.coalesce(kind, F.lit("")).alias("kind"), *([time] if time else []))
    processor = QueueProcessor(key, idle)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kinds[key]}, taken long, left long, closed boolean", "update", "eventTime" if idle is not None else "none")
