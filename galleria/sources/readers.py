"""Readers of photo trees, inline manifests, synthetic data and the data folder's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from galleria.operators.manifest import EXTENSIONS, after_key, budgeted, manifest, sharded

FILE = "path string, modificationTime timestamp, length long, content binary"
INLINE = "array<struct<identity_key: string, display_name: string, photos: array<string>>>"


def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files below a folder; bytes are read only where content is asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows if content else rows.select("path", "modificationTime", "length")


def vggface(spark: SparkSession, root: str, max_identities: int | None = None, max_photos: int | None = None, shard: int | None = None, shards: int | None = None, after: str | None = None) -> DataFrame:
    """Identities of a folder tree whose identities may lie under `faces`: those after a key, of one shard, within budgets.

    The listing is read without the files' contents; the shard is taken before the budgets count.
    """
    if shards is not None and shard is not None and not 0 <= shard < shards:
        raise ValueError("shard must be between 0 and shards - 1")
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(root).getFileSystem(spark._jsc.hadoopConfiguration())
    inner = f"{root.rstrip('/')}/faces"
    rows = after_key(manifest(files(spark, inner if fs.exists(where(inner)) else root), "vggface"), after)
    if shards is not None and shard is not None:
        rows = sharded(rows, shards, "uuid").where(F.col("shard") == shard).select(*rows.columns)
    return budgeted(rows, max_identities, max_photos)


def photo_tree(dataset: str) -> Callable[..., DataFrame]:
    def read(spark: SparkSession, root: str) -> DataFrame:
        return manifest(files(spark, root), dataset)

    return read


def inline(spark: SparkSession, text: str) -> DataFrame:
    """Identities from a JSON text; a text that can't be parsed is an error."""
    parsed = F.from_json("text", INLINE, {"mode": "FAILFAST"})
    checked = F.coalesce(parsed, F.raise_error(F.lit("the manifest is no JSON array of identities")).cast(INLINE))
    rows = spark.createDataFrame([(text,)], "text string").select(F.inline(checked))
    return rows.withColumn("photo_count", F.coalesce(F.size("photos"), F.lit(0)).cast("long"))


def synthetic(spark: SparkSession, identities: int, photos: int, seed: int = 42) -> DataFrame:
    """Identities with photos named by number and seed: a listing only, there are no contents."""
    names = F.transform(F.sequence(F.lit(0), F.lit(photos - 1)), lambda i: F.concat(F.lit("photo_"), i.cast("string"), F.lit(f"_{seed}.jpg")))
    key = F.concat(F.lit("synthetic:"), F.lpad(F.col("id").cast("string"), 6, "0"))
    return spark.range(identities).select(key.alias("identity_key"), key.alias("display_name"), names.alias("photos"), F.lit(photos).cast("long").alias("photo_count"))


def read_object(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """Bytes of stored objects by key; keys without an object have null bytes. objects: object_key, content."""
    return keys.select("object_key").distinct().join(objects, "object_key", "left")


def existing_objects(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys with a flag whether their object is there."""
    there = objects.select("object_key").distinct().withColumn("found", F.lit(True))
    return keys.join(there, "object_key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def preflight(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """One row: identities, photos, corrupt (folders below the root without a readable photo), and the newest modification.

    Empty files aren't listed by Spark, so a folder that only has such files counts as corrupt.
    """
    rows = files(spark, root)
    name, folder = F.substring_index("path", "/", -1), F.element_at(F.split("path", "/"), -2)
    suffix = F.lower(F.regexp_extract(name, r"\.[^.]+$", 0))
    where = spark._jvm.org.apache.hadoop.fs.Path
    folders = where(root).getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where(root)).getDirectoryCount() - 1
    found = rows.where(suffix.isin(*EXTENSIONS[dataset])).agg(F.countDistinct(folder).alias("identities"), F.count("*").alias("photos"), F.max("modificationTime").alias("newest"))
    return found.select("identities", "photos", F.greatest(F.lit(folders) - F.col("identities"), F.lit(0)).alias("corrupt"), "newest")


def is_current(stored_at: Column, newest: Column) -> Column:
    """Whether a stored preflight result still holds: nothing was modified after it."""
    return F.coalesce(stored_at >= newest, F.lit(False))


#: Readers by the name a job's source has.
READERS: dict[str, Callable[..., DataFrame]] = {"manifest": inline, "synthetic": synthetic, "local_vggface": vggface, "local_lfw": photo_tree("lfw"), "local_casia": photo_tree("casia")}


def load(spark: SparkSession, kind: str, *args, **options) -> DataFrame:
    """Identities from a source by its kind."""
    if kind not in READERS:
        raise ValueError(f"unknown source {kind!r}")
    return READERS[kind](spark, *args, **options)
