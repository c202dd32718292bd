"""Tables that are dealt to partitions by a hash of their key: a batch rewrites the partitions of its own rows and no others.

Rows that break a rule are kept apart with the rules they break, and counted while they are written. A merged batch is staged
before it takes the place of its partitions (dynamic partition overwrite), so a run that ended in between goes on with what
was staged, and a batch that comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from galleria.operators.ingest import upsert
from galleria.operators.quality import observed
from galleria.streaming.process_log import _files


@dataclass(frozen=True)
class KeyedTable:
    """path: rows (by part), rejected (by batch). keys identify a row; of known keys only the update columns change. order:
    which of several rows of a batch with the same key counts, the first. rules: conditions that rows must not break."""

    path: str
    keys: list[str]
    update: list[str]
    order: Callable[[], list[Column]]
    parts: int = 64
    rules: Callable[[], dict[str, Column]] = field(default=dict)

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def rows(self, spark: SparkSession, parts: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its partitions; None before its first batch."""
        fs, where = _files(spark, self.path)
        if not fs.exists(where(f"{self.path}/rows")):
            return None
        found = spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        return (found if parts is None else found.where(F.col("part").isin(parts))).drop("part")

    def rejected(self, spark: SparkSession) -> DataFrame | None:
        """Rows that broke a rule, with broken (the rules' names) and batch."""
        fs, where = _files(spark, self.path)
        return spark.read.parquet(f"{self.path}/rejected") if fs.exists(where(f"{self.path}/rejected")) else None


def merge_batch(table: KeyedTable, batch: DataFrame, batch_id: int) -> dict[str, int]:
    """Merge a batch into the table: rows seen, rows that broke a rule (broken) and how often each rule was broken.

    The source is read once: its rows are staged with their partition and the rules they break. Then the partitions that it
    touches are read, merged and staged, and put in place. Of a batch that was staged whole before, only the last step is
    done again, and the counts are empty. Null keys are a key.
    """
    spark, staged = batch.sparkSession, f"{table.path}/_staged/{batch_id}"
    fs, where = _files(spark, table.path)
    counts: dict[str, int] = {}
    if not fs.exists(where(f"{staged}/merged/_SUCCESS")):
        judged, seen = observed(batch, table.rules())
        judged.withColumn("part", table.part()).withColumn("ok", F.size("broken") == 0).write.mode("overwrite").partitionBy("ok").parquet(f"{staged}/batch")
        counts = seen.get
        split = spark.read.schema(judged.select("*", F.lit(0).alias("part"), F.lit(True).alias("ok")).schema).parquet(f"{staged}/batch")
        split.where("NOT ok").drop("ok", "part").write.mode("overwrite").parquet(f"{table.path}/rejected/batch={batch_id}")
        good = split.where("ok")
        touched = [r["part"] for r in good.select("part").distinct().collect()]  # at most table.parts
        fresh = good.select(*batch.columns)
        old = table.rows(spark, touched)
        merged = upsert(fresh.limit(0) if old is None else old, fresh, table.keys, table.update, table.order())
        merged.withColumn("part", table.part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{staged}/merged")
    merged = spark.read.schema(batch.select("*", F.lit(0).alias("part")).schema).parquet(f"{staged}/merged")
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{table.path}/rows")
    for old in fs.listStatus(where(f"{table.path}/_staged")):
        if old.getPath().getName() != str(batch_id):
            fs.delete(old.getPath(), True)
    return counts


def upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, counted: Callable[[int, dict[str, int]], None] | None = None) -> StreamingQuery:
    """Merge what is there of a stream into a table, batch by batch; counted is called with each batch's number and counts."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        counts = merge_batch(table, batch, batch_id)
        if counted:
            counted(batch_id, counts)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
