"""Rules over stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galleria.operators import quality as Q
from galleria.operators.jobs import metadata_matches, model_kinds as kinds_of
from galleria.plans.registry import query, table


@query("""SELECT o_orderkey, string_agg(rule, ',' ORDER BY o) AS broken FROM (
  SELECT o_orderkey, 1 AS o, 'status' AS rule FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
  UNION ALL SELECT o_orderkey, 2, 'price' FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 400000) GROUP BY o_orderkey""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"status": F.col("o_orderstatus").isin("O", "F"), "price": F.col("o_totalprice").between(1000, 400000)}
    return Q.violations(table(spark, sf_dir, "orders"), rules).select("o_orderkey", F.array_join("broken", ",").alias("broken"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.not_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.orphans(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "labels"), "conv_id", "doc_id").select("conv_id", "turn")


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'left only' ELSE 'right only' END AS side FROM (SELECT DISTINCT vec_id AS id FROM embeddings) a FULL JOIN (SELECT DISTINCT doc_id AS id FROM labels) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def vector_sample_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return Q.out_of_step(left, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id")


#: Payloads of which each case breaks another rule; UID stands for the row's own id.
UID = "'00000000-0000-4000-8000-' || lpad(CAST(vec_id AS VARCHAR), 12, '0')"
PAYLOADS = f"""WITH p AS (SELECT vec_id, CASE WHEN vec_id % 11 = 3 THEN 'other' WHEN vec_id % 11 = 7 THEN 'x' ELSE {UID} END AS point_id, CASE WHEN vec_id % 11 = 7 THEN 'x' ELSE {UID} END AS sample, CASE WHEN vec_id % 11 = 4 THEN 'y' ELSE {UID} END AS photo,
  CASE WHEN vec_id % 11 <> 8 THEN {UID} END AS person, CASE vec_id % 11 WHEN 5 THEN 'maybe' WHEN 9 THEN 'false' ELSE 'true' END AS active, CASE vec_id % 11 WHEN 2 THEN NULL WHEN 6 THEN ' ' ELSE 'm1' END AS model, vec_id % 11 = 1 AS more, CASE WHEN vec_id % 11 = 10 THEN embedding[1:3] ELSE embedding END AS v FROM embeddings) """
UUID_SQL = "'^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$'"


@query(PAYLOADS + f"""SELECT vec_id, concat_ws(',', CASE WHEN more THEN 'other key' END, CASE WHEN person IS NULL OR model IS NULL THEN 'missing key' END, CASE WHEN point_id <> sample THEN 'id differs' END,
  CASE WHEN NOT regexp_matches(sample, {UUID_SQL}) THEN 'sampleId is no UUID' END, CASE WHEN NOT regexp_matches(photo, {UUID_SQL}) THEN 'photoId is no UUID' END, CASE WHEN NOT regexp_matches(coalesce(person, ''), {UUID_SQL}) THEN 'personId is no UUID' END,
  CASE WHEN active NOT IN ('true', 'false') THEN 'active is no boolean' END, CASE WHEN trim(coalesce(model, '')) = '' THEN 'no model version' END, CASE WHEN len(v) <> 64 THEN 'dimension' END) AS faults FROM p""")
def payload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of vector payloads; every reason is reached."""
    k, uid = F.col("vec_id") % 11, F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("vec_id").cast("string"), 12, "0"))
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    entries = F.array(
        entry("sampleId", F.when(k == 7, "x").otherwise(uid)),
        entry("photoId", F.when(k == 4, "y").otherwise(uid)),
        F.when(k != 8, entry("personId", uid)),
        entry("active", F.when(k == 5, "maybe").when(k == 9, "false").otherwise("true")),
        F.when(k != 2, entry("modelVersion", F.when(k == 6, " ").otherwise("m1"))),
        F.when(k == 1, entry("name", F.lit("x"))),
    )
    point_id = F.when(k == 3, "other").when(k == 7, "x").otherwise(uid)
    v = F.when(k == 10, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    faults = Q.payload_faults(F.map_from_entries(F.array_compact(entries)), point_id, v, 64)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(faults, ",").alias("faults"))


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.row_counts({n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "embeddings")})


@query("SELECT count(DISTINCT user_id) AS shared FROM events WHERE event_type = 'error' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def job_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that two jobs have in common."""
    e = table(spark, sf_dir, "events")
    one, two = (e.where(F.col("event_type") == k).select("user_id") for k in ("error", "signup"))
    return one.join(two, "user_id", "left_semi").agg(F.countDistinct("user_id").alias("shared"))


@query("SELECT p_partkey, p_brand = 'Brand#2' AND p_type = 'ECONOMY' AS reusable FROM part")
def engine_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether stored metadata equals what is wanted in all keys."""
    have = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", metadata_matches(have, {"brand": "Brand#2", "type": "ECONOMY"}).alias("reusable"))


@query("""WITH outputs AS (SELECT l_orderkey AS model, 2 + 2 * (l_suppkey % 2) AS input_rank, l_partkey % 2 AS count, CASE l_linenumber % 4 WHEN 0 THEN 512 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 10 END AS channels FROM lineitem),
  groups AS (SELECT model, bool_or(channels = 1) AND bool_or(channels = 4) AND bool_or(channels = 10) AS detects, bool_or(input_rank = 4 AND channels = 512) AS recognizes FROM outputs GROUP BY model, count)
SELECT model, CASE WHEN bool_or(detects) THEN 'detector' WHEN bool_or(recognizes) THEN 'recognizer' ELSE 'unknown' END AS kind FROM groups GROUP BY model""")
def model_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by the channels of their outputs: an order is a model, its lines are outputs."""
    channels = F.element_at(F.array(*map(F.lit, (512, 1, 4, 10))), (F.col("l_linenumber") % 4).cast("int") + 1)
    rank, count = 2 + 2 * (F.col("l_suppkey") % 2), F.col("l_partkey") % 2
    outputs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("model"), rank.alias("input_rank"), count.alias("count"), channels.alias("channels"))
    return kinds_of(outputs)
