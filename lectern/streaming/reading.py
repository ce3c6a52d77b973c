"""Reading states as a stateful stream: one value of state and one timer for each document."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What a document's state holds: when it was first opened, its last progress with the event that said so, whether it was read, and the
#: number of its last change.
STATE = "entered long, progress double, at long, event_id long, read boolean, version long"
OUT = "document_id long, entered_at long, progress double, read_state string, version long, settled boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class ReadingStates(StatefulProcessor):
    """Folds events (event_id, at in µs, kind, progress) of a document into its state, in whatever order they come.

    Events come as rows: a document has few of them in a batch, for which a pandas table each would take most of the time.

    Each batch with events of a document gives a row of its state. If then no event comes for idle milliseconds of event time, the
    timer gives one more row, which is marked as settled.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        entered, progress, at, event_id, read, version = self.state.get() if self.state.exists() else (None, None, None, None, False, 0)
        latest, last, value = 0, None, None
        for event in rows:
            latest = max(latest, event.at)
            if event.kind == "open":
                entered = event.at if entered is None else min(entered, event.at)
            elif event.kind == "progress":
                if last is None or last <= (event.at, event.event_id):
                    last, value = (event.at, event.event_id), event.progress
            elif event.kind == "read":
                read = True
        if last is not None and (at is None or (at, event_id) < last):
            progress, (at, event_id) = None if value is None or value != value else min(max(float(value), 0.0), 100.0), last
        self.state.update((entered, progress, at, event_id, read, version + 1))
        for timer in [x[0] if isinstance(x, tuple) else x for x in self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest // 1000 + self.idle)
        yield self._row(key, (entered, progress, at, event_id, read, version + 1), settled=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._row(key, self.state.get(), settled=True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, state: tuple, settled: bool) -> Row:
        entered, progress, _, _, read, version = state
        shown = 100.0 if read else progress or 0.0
        name = "READ" if read else "READING" if 0 < shown < 100 else "UNREAD"
        return Row(document_id=key[0], entered_at=entered, progress=shown, read_state=name, version=version, settled=settled)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for the queries that start in the block, since transformWithState needs it; the session's setting comes back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def reading_state_changes(events: DataFrame, delay: str = "2 days", idle: str = "7 days") -> DataFrame:
    """Rows of OUT for a stream of events (document_id, event_id, ts, kind, progress): of a document's rows the last version counts.

    Events later than the delay are dropped, as the watermark says. Events without a document or a time change nothing.
    """
    rows = events.where("document_id is not null and ts is not null and kind is not null").withWatermark("ts", delay)
    rows = rows.select(F.col("document_id").cast("long").alias("document_id"), "ts", F.unix_micros("ts").alias("at"), "event_id", "kind", "progress")
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.groupBy("document_id").transformWithState(ReadingStates(wait), OUT, "Update", "EventTime")


def fold_reading_states(events: DataFrame, out: str, checkpoint: str, delay: str = "2 days", idle: str = "7 days") -> StreamingQuery:
    """Runs reading_state_changes() over what is there and writes its rows to out, a folder a batch, so that a batch that is run again
    replaces its own rows. With the same checkpoint the next run goes on where this one ended."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    with rocksdb(events.sparkSession):
        return reading_state_changes(events, delay, idle).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(spark: SparkSession, out: str) -> DataFrame:
    """document_id, entered_at (µs), progress and read_state after all changes that were written to out."""
    rows = spark.read.schema(OUT + ", batch int").parquet(out)
    last = rows.groupBy("document_id").agg(F.max_by(F.struct("entered_at", "progress", "read_state"), "version").alias("x"))
    return last.select("document_id", "x.*")
