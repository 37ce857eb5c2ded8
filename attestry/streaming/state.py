"""State by key that ends: processors with event-time timers over a RocksDB store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """Folds the rows of a key into its state; the state goes when no row came for ``keep_ms`` of event time.

    ``step(state, rows)`` gives the new state and the columns to give out;
    ``state`` is None for a key that is new or was let go.
    """

    def __init__(self, step: Callable, state: str, key: str, columns: list[str], keep_ms: int):
        self.step, self.state, self.key, self.columns, self.keep_ms = step, state, key, columns, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"{self.state}, last_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        old = tuple(self.held.get()) if self.held.exists() else None
        new, out = self.step(old[:-1] if old else None, frame)
        last = max(int(frame["event_ms"].max()), old[-1] if old else 0)
        if not old or last > old[-1]:
            if old:
                self.handle.deleteTimer(old[-1] + self.keep_ms)
            self.handle.registerTimer(last + self.keep_ms)
        self.held.update((*new, last))
        if out[0]:
            yield pd.DataFrame({self.key: [key[0]] * len(out[0]), **dict(zip(self.columns, out, strict=True))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def folded(stream: DataFrame, key: str, at: str, delay: str, step: Callable, state: str, out: str, keep_s: int) -> DataFrame:
    """(key, out): what ``step`` gives for the rows of each key as they come; state is let go after ``keep_s`` without a row.

    Rows later than the watermark are not taken in. The session is set to keep
    the state of its streams in RocksDB, on the executors' disks and in the
    checkpoint, which timers need.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = stream.withWatermark(at, delay).withColumn("event_ms", F.unix_millis(at))
    columns = [c.split()[0] for c in out.split(", ")]
    kind = stream.schema[key].dataType.simpleString()
    return timed.groupBy(key).transformWithStateInPandas(Fold(step, state, key, columns, keep_s * 1000), f"{key} {kind}, {out}", "append", "EventTime")
