"""Names, hashes, ids, buckets and display texts of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galleria.functions import display as D, identity as I
from galleria.plans.registry import query, table

KEY = "gallery-key"
_PAD = KEY.encode().ljust(64, b"\0")
INNER, OUTER = (bytes(b ^ x for b in _PAD).hex() for x in (0x36, 0x5C))


def sql_hmac(text: str) -> str:
    return f"sha256(from_hex('{OUTER}') || from_hex(sha256(from_hex('{INNER}') || encode({text}))))"


def sql_uuid5(text: str, kind: str) -> str:
    h = f"sha1(from_hex('{I.NAMESPACES[kind].replace('-', '')}') || encode({text}))"
    return f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE WHEN h[17] IN ('0','4','8','c') THEN '8' WHEN h[17] IN ('1','5','9','d') THEN '9' WHEN h[17] IN ('2','6','a','e') THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"


@query("""SELECT p_partkey, list_aggregate(w[:len(w) - 1], 'string_agg', ' ') AS first_name, w[len(w)] AS last_name, concat(list_aggregate(w[:len(w) - 1], 'string_agg', ' '), ' ', w[len(w)]) AS full_name
  FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w FROM part)""")
def split_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", I.split_name(F.concat(F.lit("  "), "p_name", F.lit("  "), "p_type")).alias("n"))
    return parts.select("p_partkey", "n.first_name", "n.last_name", I.full_name(F.col("n.first_name"), F.col("n.last_name")).alias("full_name"))


@query(f"""SELECT c_custkey, repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) AS masked,
  repeat('*', length(CAST(c_custkey AS VARCHAR))) AS masked_short, repeat('*', 24) || right({sql_hmac('c_name')}, 8) AS masked_hmac FROM customer WHERE c_custkey < 10000
  UNION ALL SELECT c_custkey, repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4), repeat('*', length(CAST(c_custkey AS VARCHAR)) - 4) || right(CAST(c_custkey AS VARCHAR), 4), repeat('*', 24) || right({sql_hmac('c_name')}, 8) FROM customer WHERE c_custkey >= 10000""")
def mask_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, number = F.col("c_name"), F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", I.mask_tail(name).alias("masked"), I.mask_tail(number).alias("masked_short"), I.mask_hmac(I.hmac_sha256(name, KEY)).alias("masked_hmac"))


@query(f"SELECT c_custkey, {sql_hmac('c_name')} AS hmac FROM customer")
def identity_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", I.hmac_sha256(F.col("c_name"), KEY).alias("hmac"))


@query(f"""SELECT doc_id, {sql_uuid5("sha256(text)", "photo")} AS photo_id, {sql_uuid5(sql_uuid5("sha256(text)", "photo") + " || ':m1'", "sample")} AS sample_id, {sql_uuid5("source", "person")} AS person_id, sha256(text) AS content_sha256 FROM documents""")
def derive_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2(F.col("text").cast("binary"), 256)

    rows = table(spark, sf_dir, "documents").select("doc_id", "source", sha.alias("content_sha256")).withColumn("photo_id", I.derived_id("photo", F.col("content_sha256")))

    return rows.select("doc_id", "photo_id", I.derived_id("sample", F.concat("photo_id", F.lit(":m1"))).alias("sample_id"), I.derived_id("person", F.col("source")).alias("person_id"), "content_sha256")


@query("""SELECT c_custkey, CAST(CAST('0x' || left(sha256(c_name), 16) AS UBIGINT) % 7 AS INTEGER) AS bucket FROM customer""")
def shard_bucket_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", I.bucket_sha(F.col("c_name"), 7).alias("bucket"))


@query(f"""SELECT c_custkey, person_id, CAST((CAST(CAST('0x' || left(replace(person_id, '-', ''), 16) AS UBIGINT) AS HUGEINT) % 7 * {2**64 % 7} + CAST('0x' || right(replace(person_id, '-', ''), 16) AS UBIGINT) % 7) % 7 AS INTEGER) AS bucket
  FROM (SELECT c_custkey, {sql_uuid5('c_name', 'person')} AS person_id FROM customer)""")
def shard_bucket_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", I.derived_id("person", F.col("c_name")).alias("person_id"))
    return rows.select("c_custkey", "person_id", I.bucket_uuid(F.col("person_id"), 7).alias("bucket"))


@query(r"""SELECT page_id, left(regexp_replace('failed at ' || url || ' twice', '[/\\][^\s]{4,}', '<path>', 'g'), 500) AS message FROM pages""")
def sanitize_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", I.sanitize_message(F.concat(F.lit("failed at "), "url", F.lit(" twice"))).alias("message"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.enrolled'), json_extract_string(props, '$.k'), '0') AS first_known FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the JSON column, and the first known of several names."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.enrolled"), F.get_json_object("props", "$.k"), F.lit("0")).alias("first_known"))


@query("""SELECT event_id, CAST(CAST(round(CAST(least(1, greatest(0, value / 100)) AS DECIMAL(20,10)), 2) AS DECIMAL(20,2)) AS VARCHAR) AS similarity,
  CAST(CAST(round(CAST(least(1, greatest(0, value / 100)) * 100 AS DECIMAL(20,10)), 1) AS DECIMAL(20,1)) AS VARCHAR) || '%' AS percent,
  CASE WHEN value / 100 - 0.25 >= 0 THEN '+' ELSE '' END || CAST(CAST(round(CAST(value / 100 - 0.25 AS DECIMAL(20,10)), 2) AS DECIMAL(20,2)) AS VARCHAR) AS margin,
  CAST(least(100, round(CAST(event_id AS DOUBLE) / CAST(5000 AS DOUBLE) * 100)) AS BIGINT) AS progress FROM events""")
def similarity_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("value") / 100
    return table(spark, sf_dir, "events").select("event_id", D.similarity_text(score).alias("similarity"), D.similarity_percent(score).alias("percent"), D.margin_text(score, F.lit(0.25)).alias("margin"), D.progress_percent(F.col("event_id"), F.lit(5000)).alias("progress"))


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE concat(c_name, ' ', c_mktsegment) ILIKE '%9%build%' OR c_mktsegment ILIKE '%9%build%'""")
def search_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive search in names; % and _ of the text looked for are wildcards."""
    pattern = "%9%build%"
    return table(spark, sf_dir, "customer").where(F.concat_ws(" ", "c_name", "c_mktsegment").ilike(pattern) | F.col("c_mktsegment").ilike(pattern)).select("c_custkey", "c_name", "c_mktsegment")


@query("""WITH t AS (SELECT count(*) AS n FROM customer) SELECT c_nationkey * 10 AS "offset", CAST(c_nationkey * 10 // 20 + 1 AS BIGINT) AS page, CAST((n + 19) // 20 AS BIGINT) AS pages, CAST(least(c_nationkey * 10 + 1, n) AS BIGINT) AS first_row, CAST(least(c_nationkey * 10 + 20, n) AS BIGINT) AS last_row
  FROM (SELECT DISTINCT c_nationkey FROM customer), t""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer")
    total = people.agg(F.count("*").alias("n"))
    rows = people.select((F.col("c_nationkey") * 10).alias("offset")).distinct().join(F.broadcast(total))
    return rows.select("offset", D.page_numbers(F.col("offset"), F.lit(20), F.col("n")).alias("p")).select("offset", *[F.col(f"p.{c}").cast("long").alias(c) for c in ("page", "pages", "first_row", "last_row")])


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || '+00:00' AS at FROM events""")
def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", D.iso_utc(F.col("ts").cast("timestamp")).alias("at"))
