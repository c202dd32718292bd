"""How tables lie on disk: rows found by id in few row groups, tables joined by person without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of a row group of tables whose rows are looked up one by one.
GROUP_BYTES = 1 << 20


def store_by_id(rows: DataFrame, path: str, key: str, group_bytes: int = GROUP_BYTES) -> None:
    """Write rows in the order of a key, in small row groups with a Bloom filter of the key in each.

    Ranges of the key are dealt to tasks, so files and row groups have bounds that exclude each other; for keys without an
    order that means anything (UUIDs), the filters say which of the groups in question has the key.
    """
    dealt = rows.repartitionByRange(key).sortWithinPartitions(key)
    dealt.write.option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", 1000).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def find(spark: SparkSession, path: str, key: str, ids: list, columns: list[str] | None = None) -> DataFrame:
    """Rows of some ids, with all columns or some (the payload without the vector, say); unknown ids give nothing.

    The ids are a request's: they are sent to the scan, which skips files, row groups and pages without them.
    """
    rows = spark.read.parquet(path)
    return rows.where(F.col(key).isin(ids)).select(*(columns or rows.columns))


def store_by_person(rows: DataFrame, path: str, name: str, key: str = "person_id", buckets: int = 16) -> DataFrame:
    """Write rows as a table of the catalog in buckets of a key, and read it.

    Tables of one key and number of buckets are joined, and each is grouped by the key, bucket by bucket: no rows move.
    Persons with very many rows make their bucket large; Spark's splitting of skewed joins needs a shuffle.
    """
    dealt = rows.repartition(buckets, key)  # the buckets' own hash: a task writes one file
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)
