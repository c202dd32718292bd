"""Run a stream to the end of what is there and read its result as a table."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share (spark.checkpoint.dir); one of our own only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or os.path.join(tempfile.gettempdir(), "galleria-streams")
    return f"{base}/{uuid.uuid4().hex}"


def complete(stream: DataFrame) -> DataFrame:
    """The whole result of an aggregating stream, as of its last batch."""
    spark = stream.sparkSession
    at = folder(spark)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/result")

    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/result")


def appended(stream: DataFrame) -> DataFrame:
    """All rows that a stream has sent on."""
    spark = stream.sparkSession
    at = folder(spark)
    stream.writeStream.format("parquet").option("path", f"{at}/result").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/result")
