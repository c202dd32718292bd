"""State kept between the batches of a stream, with timers that let go of what is idle: trailing values, first writers.

The state lies in RocksDB on the executors and is written with the stream's checkpoint, so it isn't bounded by memory and a
run that is started again goes on with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, as state with timers must."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class _Idle(StatefulProcessor):
    """A processor whose state goes when the watermark is idle_ms past the newest time of its key."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def keep_until(self, newest_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest_ms + self.idle_ms)

    def close(self) -> None:
        pass


class Trailing(_Idle):
    """For each event the rate of its process over the last span seconds, and percentiles of its last n values."""

    def __init__(self, n: int, span: int, idle_ms: int) -> None:
        super().__init__(idle_ms)
        self.n, self.span = n, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getListState("kept", "s long, done long, value double")
        self.done = handle.getValueState("done", "done long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        done = self.done.get()[0] if self.done.exists() else 0
        seconds, out = (batch["ts"].astype("datetime64[us]").astype("int64") // 1_000_000).tolist(), []
        for s, event_id, value in zip(seconds, batch["event_id"], batch["value"], strict=True):
            done += 1
            held.append((s, done, value))
            last = len(held) - self.n
            held = [r for i, r in enumerate(held) if i >= last or r[0] >= s - self.span]
            first = next(r for r in held if r[0] >= s - self.span)
            values = np.array([r[2] for r in held[-self.n :] if r[2] == r[2] and r[2] is not None], float)
            p50, p95 = np.quantile(values, [0.5, 0.95]) if len(values) else (0.0, 0.0)
            out.append((key[0], event_id, (done - first[1]) / (s - first[0]) if s > first[0] else 0.0, min(done, self.n), p50, p95))
        self.kept.put(held)
        self.done.update((done,))
        self.keep_until(max(seconds) * 1000)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "rate", "n", "p50", "p95"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.kept.clear()
        self.done.clear()
        yield pd.DataFrame([], columns=["user_id", "event_id", "rate", "n", "p50", "p95"])


def trailing(events: DataFrame, n: int = 60, span: int = 60, late: str = "10 minutes", idle_seconds: int = 30 * 86400) -> DataFrame:
    """user_id, event_id, rate (events a second over the last span seconds, as `metrics.trailing_rate` gives it), n, p50 and
    p95 of the last n values up to the event.

    events: user_id, event_id, ts, value; each user's come in order, but for the order within a batch. A null value counts as
    an event and isn't among the percentiles. A user's state goes idle_seconds after the last event. Start within `rocksdb`.
    """
    known = events.select("user_id", "event_id", "ts", "value").withWatermark("ts", late)
    out = "user_id long, event_id long, rate double, n long, p50 double, p95 double"
    return known.groupBy("user_id").transformWithStateInPandas(Trailing(n, span, 1000 * idle_seconds), out, "Append", "EventTime")


class FirstWriter(_Idle):
    """Marks the first row of a key; others name the one that won."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.won = handle.getValueState("won", "id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("id")
        won = self.won.get()[0] if self.won.exists() else None
        fresh = np.zeros(len(batch), bool)
        if won is None:
            won, fresh[0] = int(batch["id"].iloc[0]), True
            self.won.update((won,))
        self.keep_until(int(batch["ts"].max().timestamp() * 1000))
        yield pd.DataFrame({"content": key[0], "id": batch["id"], "fresh": fresh, "won": won})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.won.clear()
        yield pd.DataFrame({"content": [], "id": [], "fresh": [], "won": []})


def first_writers(rows: DataFrame, late: str = "10 minutes", idle_seconds: int = 86400) -> DataFrame:
    """content, id, fresh (whether the row is the first of its content), won (the id that is).

    rows: content, id (no nulls), ts. Of a batch the least id counts, then the batch that came first. A content is forgotten
    idle_seconds after its last row, so that the state doesn't grow for good. Start within `rocksdb`.
    """
    known = rows.select("content", "id", "ts").withWatermark("ts", late)
    return known.groupBy("content").transformWithStateInPandas(FirstWriter(1000 * idle_seconds), "content string, id long, fresh boolean, won long", "Append", "EventTime")


def joined_shards(parents: DataFrame, records: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Shards of parents with their records as streams: job_id, process_id, started, status and the records' other columns.

    parents: job_id, process_id, started; records: process_id, reported (timestamps), status and more. A record belongs to
    its shard if it was reported within that time of the start; once the watermark says that none can come any more, the
    shard is queued. Records that come later than that are left out.
    """
    left = parents.withWatermark("started", late)
    right = records.withColumnRenamed("process_id", "record_id").withWatermark("reported", late)
    near = (F.col("process_id") == F.col("record_id")) & (F.col("reported") >= F.col("started")) & (F.col("reported") <= F.col("started") + F.expr(f"INTERVAL {within}"))
    both = left.join(right, near, "left_outer")
    return both.drop("record_id").withColumn("status", F.coalesce("status", F.lit("queued")))
