"""What several corpus operators share: arrow batches, row keys, checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

#: Rows that Python looks at together. Texts can have 100,000 characters and more.
BATCH_ROWS = 256
#: Bytes of an Arrow batch; each task holds one on its way to Python and one on its way back.
BATCH_BYTES = 4 << 20
#: Bytes up to which a table is broadcast; its size is measured each time.
SMALL = 12 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark (the folder may be in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Let the session hand at most BATCH_BYTES to Python at once; a lower limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (of at most spark.sql.execution.arrow.maxBytesPerBatch) in short pieces, to bound what Python adds."""
    for batch in batches:
        for first in range(0, max(1, batch.num_rows), BATCH_ROWS):
            yield batch.slice(first, BATCH_ROWS)


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str | StructType) -> DataFrame:
    """Apply a function to short Arrow batches of a DataFrame; no shuffle, one batch in memory."""
    bound_batches(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = rows(batch.rename_columns(names))
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    # Columns go to Python by number: their names may hold dots.
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; one of our own only in local mode (tests)."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "galleria-checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder: later jobs read the rows again even if executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, written densely to a folder of their own in the shared folder and read again, and that folder."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder whose rows aren't read any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def width(df: DataFrame) -> Column:
    """Bytes of a row, about: texts and arrays by their length."""
    parts = [F.lit(16)]
    for f in df.schema.fields:
        kind, c = f.dataType, F.col(f"`{f.name}`")
        if isinstance(kind, (StringType, BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)) + 16)
        elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
            parts.append(F.coalesce(F.octet_length(F.array_join(c, " ")) + 24 * F.size(c), F.lit(0)) + 16)
        elif isinstance(kind, ArrayType):
            parts.append(F.coalesce(8 * F.size(c), F.lit(0)) + 16)
        else:
            parts.append(F.lit(8))
    return reduce(lambda a, b: a + b, parts).cast("long")


def is_small(df: DataFrame) -> bool:
    """Whether a table (written or checkpointed before) has at most SMALL bytes."""
    return (df.agg(F.sum(width(df))).first()[0] or 0) <= SMALL


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint for a table whose measured size allows it; a larger one is shuffled."""
    return F.broadcast(df) if is_small(df) else df


def narrowed(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """The rows of df whose key stands in keys (written or checkpointed before).

    A small table of keys is broadcast. Beyond that the join's result is checkpointed, so that no later aggregate reuses
    its distribution and Spark can split the rows of a frequent key.
    """
    if is_small(keys):
        return df.join(F.broadcast(keys), on, "left_semi")
    return cut_lineage(df.join(keys, on, "left_semi"))


def shuffle_parts(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
