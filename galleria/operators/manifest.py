"""Identity manifests from file listings: grouping, budgets, resume cursors and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from galleria.functions.identity import bucket_sha, bucket_uuid, derived_id, display_folder

#: Extensions of photos, and prefixes of identity keys, by kind of folder tree.
EXTENSIONS = {"lfw": (".jpg", ".jpeg", ".png"), "casia": (".jpg", ".jpeg", ".png"), "vggface": (".jpg", ".jpeg", ".png", ".webp", ".bmp")}
PREFIXES = {"lfw": "lfw:", "casia": "", "vggface": "vggface:"}


def manifest(files: DataFrame, dataset: str) -> DataFrame:
    """One row for each folder with photos: identity_key, display_name, photos (sorted names), photo_count.

    files: path, whose last two parts are a folder and a file name. Other files and folders without photos are left out.
    """
    name, folder = F.substring_index("path", "/", -1), F.trim(F.element_at(F.split("path", "/"), -2))
    suffix = F.lower(F.regexp_extract(name, r"\.[^.]+$", 0))
    display = {"lfw": display_folder(folder), "casia": folder, "vggface": F.concat(F.lit("VGGFace "), folder)}[dataset]
    rows = files.where(suffix.isin(*EXTENSIONS[dataset])).select(F.concat(F.lit(PREFIXES[dataset]), folder).alias("identity_key"), display.alias("display_name"), name.alias("name"))
    return rows.groupBy("identity_key", "display_name").agg(F.sort_array(F.collect_list("name")).alias("photos")).withColumn("photo_count", F.size("photos").cast("long"))


def budgeted(rows: DataFrame, max_identities: int | None = None, max_photos: int | None = None) -> DataFrame:
    """The first identities by key within both budgets; the last one may keep a part of its photos.

    The budget is a prefix of the order, so at most max_identities rows (each identity has a photo, so max_photos bounds
    them too) are ordered in one place, after a top-k in each partition.
    """
    bound = min(x for x in (max_identities, max_photos, 2**31 - 1) if x is not None)
    head = rows.orderBy("identity_key").limit(bound) if max_identities is not None or max_photos is not None else rows
    if max_photos is None:
        return head
    before = F.sum("photo_count").over(Window.orderBy("identity_key")) - F.col("photo_count")
    left = F.lit(max_photos) - F.col("before")
    kept = head.withColumn("before", before).where(F.col("before") < max_photos)
    return kept.withColumn("photos", F.slice("photos", 1, F.least(F.size("photos").cast("long"), left).cast("int"))).withColumn("photo_count", F.size("photos").cast("long")).drop("before")


def after_key(rows: DataFrame, key: str | None) -> DataFrame:
    """Rows that a resumed job still has to do."""
    return rows if key is None else rows.where(F.col("identity_key") > key)


def sharded(rows: DataFrame, n: int, how: str = "sha") -> DataFrame:
    """Adds person_id and shard (0 to n - 1), by the hash of the id or by the id as a number."""
    person = rows.withColumn("person_id", derived_id("person", F.col("identity_key")))
    return person.withColumn("shard", bucket_sha(F.col("person_id"), n) if how == "sha" else bucket_uuid(F.col("person_id"), n))


def cardinality(rows: DataFrame) -> DataFrame:
    """Identities and photos of a manifest."""
    return rows.agg(F.countDistinct("identity_key").alias("identities"), F.coalesce(F.sum("photo_count"), F.lit(0)).alias("photos"))
