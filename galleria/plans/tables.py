"""The library's tables as far as the test tables stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galleria.plans.registry import table

SQL = """WITH persons AS (SELECT c_custkey AS person_id, c_nationkey AS identity_id, c_name AS name, c_acctbal >= 0 AS is_active, CAST(c_custkey % 97 AS BIGINT) AS created_at FROM customer),
identities AS (SELECT n_nationkey AS identity_id, n_name AS display_name FROM nation),
photos AS (SELECT o_orderkey AS photo_id, o_custkey AS person_id, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'deleted' ELSE 'staged' END AS status, o_orderdate AS created_at FROM orders),
results AS (SELECT conv_id AS request_id, turn AS face_index, CASE WHEN role = 'assistant' THEN 'known' ELSE 'unknown' END AS status, length(text) % 150 AS person_id FROM conversations),
requests AS (SELECT conv_id AS request_id, max(turn) AS created_at FROM conversations GROUP BY conv_id)
"""


def persons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("identity_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") >= 0).alias("is_active"), (F.col("c_custkey") % 97).alias("created_at"))


def identities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("identity_id"), F.col("n_name").alias("display_name"))


def photos(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "deleted").otherwise("staged")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("photo_id"), F.col("o_custkey").alias("person_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("face_index"), F.when(F.col("role") == "assistant", "known").otherwise("unknown").alias("status"), (F.length("text") % 150).cast("long").alias("person_id"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("request_id")).agg(F.max("turn").alias("created_at"))
