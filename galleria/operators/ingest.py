"""Copy-on-write mutations of plain tables: a table and a batch give the next state of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order of arrival."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first writer of a key wins: rows of the batch whose key is there already are left out."""
    fresh = first_of(incoming, keys, order).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], update: list[str], order: list[Column]) -> DataFrame:
    """New keys are added; of known ones the update columns are overwritten and all others keep their old value."""
    batch = first_of(incoming, keys, order).select(*existing.columns)
    new = batch.select(*keys, *[F.col(c).alias(f"__{c}") for c in existing.columns if c not in keys], F.lit(True).alias("__new"))
    old = existing.withColumn("__old", F.lit(True))
    joined = old.join(new, keys, "full_outer")
    picked = [F.when(F.col("__old") & ~F.coalesce("__new", F.lit(False)), F.col(c)).when(F.col("__old") & (F.lit(c not in update)), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in existing.columns if c not in keys]
    return joined.select(*keys, *picked).select(*existing.columns)


def append_strict(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table with the batch appended, and the rows of the batch that break the key (none may)."""
    twice = incoming.groupBy(*keys).count().where("count > 1").select(*keys)
    known = existing.select(*keys)
    return existing.unionByName(incoming), incoming.join(known.unionByName(twice).distinct(), keys, "left_semi")


def delete(existing: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the rows of these keys; unknown keys do nothing."""
    return existing.join(ids.select(*keys).distinct(), keys, "left_anti")


def set_flag(existing: DataFrame, ids: DataFrame, key: str, column: str, value: bool) -> DataFrame:
    """The table with a boolean column set in the rows of these keys."""
    marked = existing.join(ids.select(key).distinct().withColumn("__set", F.lit(True)), key, "left")
    return marked.withColumn(column, F.when(F.col("__set"), F.lit(value)).otherwise(F.col(column))).select(*existing.columns)


def soft_delete_persons(persons: DataFrame, photos: DataFrame, ids: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Persons and photos after these active persons are deleted, and the ids that weren't active persons."""
    asked = ids.select("person_id").distinct()
    hit = asked.join(persons.where("is_active").select("person_id"), "person_id", "left_semi")
    gone = hit.withColumn("__gone", F.lit(True))
    people = persons.join(gone, "person_id", "left").withColumn("is_active", F.col("is_active") & F.col("__gone").isNull()).drop("__gone")
    going = F.col("__gone").isNotNull() & (F.col("status") != "deleted")
    after = photos.join(gone, "person_id", "left").withColumns({"deleted_at": F.when(going, as_of), "status": F.when(going, "deleted").otherwise(F.col("status"))}).drop("__gone")
    return people, after, asked.join(hit, "person_id", "left_anti")


def duplicate_photos(photos: DataFrame) -> DataFrame:
    """Photos of the same person with the same content: person_id, content, n, photo_ids."""
    return photos.groupBy("person_id", "content").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("photo_id")).alias("photo_ids")).where("n > 1")


def shared_content(photos: DataFrame) -> DataFrame:
    """Contents that stand under several persons; ids derived from the content alone would collide."""
    return photos.groupBy("content").agg(F.countDistinct("person_id").alias("n_persons"), F.count("*").alias("n_photos"), F.min("photo_id").alias("first_photo_id")).where("n_persons > 1")


def validated(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be enrolled, and rejects as (index, message); items: index, name, national_id, length (of bytes)."""
    message = F.when(F.coalesce(F.col("length"), F.lit(0)) == 0, "empty image").when(F.trim(F.coalesce("name", F.lit(""))) == "", "missing name").when(F.trim(F.coalesce("national_id", F.lit(""))) == "", "missing national id")
    marked = items.withColumn("message", message)
    return marked.where("message IS NULL").drop("message"), marked.where("message IS NOT NULL").select("index", "message")


def zipped(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Elements of two array columns of the same key, by position; raises where the sizes differ."""
    both = left.join(right, "key")
    checked = both.withColumn(a, F.when(F.size(a) == F.size(b), F.col(a)).otherwise(F.raise_error(F.lit("numbers of files and rows differ"))))
    return checked.select("key", F.posexplode(F.arrays_zip(a, b)).alias("position", "pair")).select("key", "position", f"pair.{a}", f"pair.{b}")
