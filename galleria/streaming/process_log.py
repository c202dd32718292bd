"""Event logs as streams: extensions of the batch operators, as the log itself is append-only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from galleria.operators.jobs import NEXT

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events of Parquet files as a stream; bounded files per trigger hold back a fast producer.

    The path may be a folder or a single file; as a pattern, both are listed alike.
    """
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and mean value by type and time window; windows are final once the watermark has passed them."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events with no larger gap between them."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def latest_state(events: DataFrame) -> DataFrame:
    """The newest event of each process, for the update or complete mode."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")


def checked_transitions(events: DataFrame) -> DataFrame:
    """Each state change of a process with whether it is allowed. events: process_id, sequence, status.

    The last status of a process is kept as state; within a batch its events are taken by sequence.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "pending"
        rows = pd.concat(list(batches)).sort_values("sequence")
        out = []
        for sequence, status in zip(rows["sequence"], rows["status"], strict=True):
            valid = status in NEXT.get(now, ())
            out.append((key[0], int(sequence), now, status, valid))
            if valid:
                now = status
        state.update((now,))
        yield pd.DataFrame(out, columns=["process_id", "sequence", "before", "after", "valid"])

    return events.groupBy("process_id").applyInPandasWithState(step, "process_id long, sequence long, before string, after string, valid boolean", "status string", "append", GroupStateTimeout.NoTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run a stream over what is there, into Parquet; a second run goes on where the first ended."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the class of its paths."""
    where = spark._jvm.org.apache.hadoop.fs.Path
    return where(path).getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, target: str) -> list[int]:
    """Complete versions of a table, in order. The last one is the table."""
    fs, where = _files(spark, target)
    if not fs.exists(where(target)):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(where(target))]
    found = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
    return sorted(n for n in found if fs.exists(where(f"{target}/v={n}/_SUCCESS")))


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The table that `upsert_each_batch` keeps, None before its first batch."""
    known = versions(spark, target)
    return spark.read.parquet(f"{target}/v={known[-1]}") if known else None


def upsert_each_batch(stream: DataFrame, target: str, checkpoint: str, apply: Callable[[DataFrame | None, DataFrame], DataFrame]):
    """Run a stream whose batches are merged into a table by apply(existing or None, batch).

    Each batch writes the next version of the table and then removes those before the last one, which a reader may still
    have open. apply merges by the rows' keys, and no batch is skipped: one that comes again, with more rows perhaps, is
    merged again and adds what is new. A version that wasn't finished has no mark and is written anew.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = versions(spark, target)
        following = known[-1] + 1 if known else 0
        apply(current(spark, target), batch).write.mode("overwrite").parquet(f"{target}/v={following}")
        fs, where = _files(spark, target)
        for old in known[:-1]:
            fs.delete(where(f"{target}/v={old}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CANCELLED = "cancelled between batches"


def cancellable(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], cancelled: Callable[[], bool]) -> bool:
    """Run step on each batch of what is there until cancelled() holds before one; whether it went to the end.

    The batch before which it ends isn't begun, so a later run goes on with it.
    """

    def guarded(batch: DataFrame, batch_id: int) -> None:
        if cancelled():
            raise RuntimeError(CANCELLED)
        step(batch, batch_id)

    query = stream.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if CANCELLED not in str(e):
            raise
        return False
    return True


class BatchProgress(StreamingQueryListener):
    """Hands each batch's progress on: a row of job, batch, rows, rows a second and seconds."""

    def __init__(self, job: str, report: Callable[[dict], None]) -> None:
        self.job, self.report = job, report

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name == self.job:
            self.report({"job": self.job, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "seconds": p.batchDuration / 1000})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def run_job(stream: DataFrame, job: str, checkpoint: str, step: Callable[[DataFrame, int], None], report: Callable[[dict], None], cancelled: Callable[[], bool] = lambda: False, poll: float = 0.2) -> bool:
    """Run step on each batch of what is there, report each one's progress, stop once cancelled() holds; whether it went to
    the end.

    A batch that a stop cuts short is done again by the next run with this checkpoint, so step must bear that, as merges by
    key do. job names the query; one query of a name runs at a time.
    """
    spark, listener = stream.sparkSession, BatchProgress(job, report)
    spark.streams.addListener(listener)
    try:
        query = stream.writeStream.queryName(job).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        while not query.awaitTermination(poll):
            if cancelled():
                query.stop()
                return False
        return True
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # the last batch's progress
        spark.streams.removeListener(listener)
