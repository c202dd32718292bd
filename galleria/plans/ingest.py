"""Mutations and manifests over stand-in tables: documents are photos, sources are persons, page urls are folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galleria.operators import ingest as I, manifest as M
from galleria.plans import tables as T
from galleria.plans.registry import query, table


def doc_photos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("photo_id"), F.col("source").alias("person_id"), F.sha2(F.col("text").cast("binary"), 256).alias("content"))


@query("SELECT doc_id AS photo_id, source AS person_id, sha256(text) AS content FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.first_of(doc_photos(spark, sf_dir), ["content"], [F.col("photo_id")])


def old_photos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("photo_id"), F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("mime"), F.lit("old").alias("status"))


def new_photos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("photo_id"), F.col("l_suppkey").alias("person_id"), F.col("l_returnflag").alias("mime"), F.lit("active").alias("status"), "l_linenumber", "l_partkey", "l_extendedprice")


ARRIVAL = ["l_linenumber", "l_partkey", "l_extendedprice"]
BATCH = """WITH old AS (SELECT o_orderkey AS photo_id, o_custkey AS person_id, o_orderpriority AS mime, 'old' AS status FROM orders WHERE o_orderstatus <> 'P'),
new AS (SELECT l_orderkey AS photo_id, l_suppkey AS person_id, l_returnflag AS mime, 'active' AS status FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) = 1) """


@query(BATCH + "SELECT * FROM old UNION ALL SELECT * FROM new WHERE photo_id NOT IN (SELECT photo_id FROM old)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.insert_ignore(old_photos(spark, sf_dir), new_photos(spark, sf_dir), ["photo_id"], [F.col(c) for c in ARRIVAL])


@query(BATCH + """SELECT photo_id, coalesce(new.person_id, old.person_id) AS person_id, CASE WHEN old.photo_id IS NULL THEN new.mime ELSE old.mime END AS mime, coalesce(new.status, old.status) AS status
  FROM old FULL JOIN new USING (photo_id)""")
def upsert_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner and status are overwritten, the type of known photos stays."""
    return I.upsert(old_photos(spark, sf_dir), new_photos(spark, sf_dir), ["photo_id"], ["person_id", "status"], [F.col(c) for c in ARRIVAL])


@query(T.SQL + """SELECT f.photo_id, f.person_id, CASE WHEN p.is_active AND p.identity_id = 7 THEN 'deleted' ELSE f.status END AS status,
  p.is_active AND p.identity_id <> 7 AS is_active FROM photos f JOIN persons p USING (person_id)""")
def soft_delete_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All persons of one identity are deleted with their photos."""
    people = T.persons(spark, sf_dir)
    after, photos, _ = I.soft_delete_persons(people, T.photos(spark, sf_dir), people.where("identity_id = 7"), F.lit("2024-01-01").cast("timestamp"))
    return photos.join(after.select("person_id", "is_active"), "person_id").select("photo_id", "person_id", "status", "is_active")


@query("SELECT source AS person_id, sha256(text) AS content, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS photo_ids FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_photo_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.duplicate_photos(doc_photos(spark, sf_dir)).withColumn("photo_ids", F.array_join(F.col("photo_ids").cast("array<string>"), ","))


@query("SELECT sha256(text) AS content, count(DISTINCT source) AS n_persons, count(*) AS n_photos, min(doc_id) AS first_photo_id FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_person_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.shared_content(doc_photos(spark, sf_dir))


@query("SELECT person_id, photo_id, status, status = 'staged' AS active FROM (SELECT o_custkey AS person_id, o_orderkey AS photo_id, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'deleted' ELSE 'staged' END AS status FROM orders) WHERE status <> 'deleted'")
def set_active_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of active photos are switched off, those of deleted ones removed."""
    rows = T.photos(spark, sf_dir).select("person_id", "photo_id", "status").withColumn("active", F.lit(True))
    off = I.set_flag(rows, rows.where("status = 'active'"), "photo_id", "active", False)
    return I.delete(off, rows.where("status = 'deleted'"), ["photo_id"])


FOLDERS = """WITH files AS (SELECT split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS folder, page_id || CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.jpeg' ELSE '.txt' END AS name FROM pages),
m AS (SELECT 'lfw:' || folder AS identity_key, replace(folder, '_', ' ') AS display_name, string_agg(name, ',' ORDER BY name) AS photos, count(*) AS photo_count FROM files WHERE name NOT LIKE '%.txt' GROUP BY 1, 2) """


def page_files(spark: SparkSession, d: str) -> DataFrame:
    host = F.element_at(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/"), 1)
    suffix = F.element_at(F.array(*map(F.lit, (".JPG", ".png", ".jpeg", ".txt"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select(F.concat(F.lit("/data/"), host, F.lit("/"), F.col("page_id").cast("string"), suffix).alias("path"))


@query(FOLDERS + "SELECT * FROM m")
def manifest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.manifest(page_files(spark, sf_dir), "lfw").withColumn("photos", F.array_join("photos", ","))


@query(FOLDERS + """, b AS (SELECT *, sum(photo_count) OVER (ORDER BY identity_key) - photo_count AS before FROM m)
  SELECT identity_key, CAST(least(photo_count, 100 - before) AS BIGINT) AS photo_count, array_to_string(string_split(photos, ',')[1:CAST(least(photo_count, 100 - before) AS BIGINT)], ',') AS photos FROM b WHERE before < 100""")
def manifest_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred photos; the last identity keeps a part of its own."""
    kept = M.budgeted(M.manifest(page_files(spark, sf_dir), "lfw"), max_photos=100)
    return kept.select("identity_key", "photo_count", F.array_join("photos", ",").alias("photos"))


@query(FOLDERS + "SELECT identity_key, photo_count FROM m WHERE identity_key > 'lfw:m'")
def resume_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.after_key(M.manifest(page_files(spark, sf_dir), "lfw"), "lfw:m").select("identity_key", "photo_count")


@query(FOLDERS + "SELECT count(DISTINCT identity_key) AS identities, CAST(sum(photo_count) AS BIGINT) AS photos FROM m")
def manifest_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cardinality(M.manifest(page_files(spark, sf_dir), "lfw"))
