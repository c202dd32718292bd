"""Search queries over `embeddings`: the rows whose vec_id is divisible by 20 are looked up among all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galleria.functions import vectors as V
from galleria.operators import layout as L, topk as T, vector_index as I
from galleria.plans.registry import query, table
from galleria.streaming.run import folder

THRESHOLD, K = 0.35, 5

RANKED = """
WITH hits AS (
  SELECT q.vec_id AS query_id, g.vec_id AS sample_id, CAST(g.label AS BIGINT) AS person_id,
    round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[])), 6) + 0.0 AS score
  FROM embeddings q JOIN embeddings g ON q.vec_id <> g.vec_id WHERE q.vec_id % 20 = 0 {keep}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sample_id) AS rank FROM hits
)
"""


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("long").alias("person_id"), "embedding")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(RANKED.format(keep="") + f"SELECT query_id, sample_id, person_id, score, rank, CASE WHEN score >= {THRESHOLD} THEN 'known' ELSE 'unknown' END AS status FROM ranked WHERE rank <= {K}")
def recognize_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gallery(spark, sf_dir)
    hits = T.topk(probes(spark, sf_dir), g, K).join(g.select("sample_id", "person_id"), "sample_id")
    return hits.select("query_id", "sample_id", "person_id", "score", F.col("rank").cast("long").alias("rank"), T.decision(F.col("score"), THRESHOLD).alias("status"))


@query(RANKED.format(keep="") + f"SELECT query_id, sample_id AS best_sample_id, person_id AS best_person_id, score AS best_score, CASE WHEN score >= {THRESHOLD} THEN 'known' ELSE 'unknown' END AS status FROM ranked WHERE rank = 1")
def recognize_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("person_id"), F.col("n_name").alias("name"))
    return T.recognize(probes(spark, sf_dir), gallery(spark, sf_dir), people, K, THRESHOLD).select("query_id", "best_sample_id", "best_person_id", "best_score", "status")


@query(RANKED.format(keep="AND g.label < 5 AND g.vec_id % 2 = 1") + f"SELECT query_id, sample_id, score, rank FROM ranked WHERE rank <= {K}")
def recognize_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter (model version and active flag in a real gallery) is applied before the search."""
    keep = (F.col("person_id") < 5) & (F.col("sample_id") % 2 == 1)
    return T.topk(probes(spark, sf_dir), gallery(spark, sf_dir), K, keep).select("query_id", "sample_id", "score", F.col("rank").cast("long").alias("rank"))


@query(RANKED.format(keep="") + f"""
SELECT query_id, rank, sample_id, coalesce('id-' || n_nationkey, 'sample-' || sample_id) AS face_id, n_name AS name, score
FROM ranked LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 7) ON n_nationkey = person_id WHERE rank <= {K}""")
def face_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as nested rows, unfolded: a candidate without a person is named by its sample."""
    people = table(spark, sf_dir, "nation").where("n_nationkey < 7").select(F.col("n_nationkey").cast("long").alias("person_id"), F.col("n_name").alias("name"))
    nested = T.recognize(probes(spark, sf_dir), gallery(spark, sf_dir), people, K, THRESHOLD)
    rows = nested.select("query_id", F.inline("candidates"))
    face = F.when(F.col("name").isNotNull(), F.concat(F.lit("id-"), F.col("person_id").cast("string"))).otherwise(F.concat(F.lit("sample-"), F.col("sample_id").cast("string")))
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "sample_id", face.alias("face_id"), "name", "score")


@query("""SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, round(sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])), 6) AS norm,
  len(embedding) = 64 AND list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding]) > 0 AS valid FROM embeddings""")
def vector_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(v).cast("long").alias("dim"), F.round(V.norm(v), 6).alias("norm"), (F.size(V.faults(v, 64)) == 0).alias("valid"))


@query("""SELECT vec_id, i - 1 AS place, round(CAST(embedding[i] AS DOUBLE) * 3.5 / sqrt(list_sum([(x * 3.5) * (x * 3.5) FOR x IN CAST(embedding AS DOUBLE[])])), 6) + 0.0 AS value
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform(V.doubles(F.col("embedding")), lambda x: x * 3.5)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.l2_normalize(scaled)).alias("place", "x")).select("vec_id", F.col("place").cast("long").alias("place"), (F.round("x", 6) + 0.0).alias("value"))


@query()
def recognize_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k by bands of random projections; its recall against the exact search is measured in the tests."""
    return T.approximate_topk(probes(spark, sf_dir), gallery(spark, sf_dir), 64, K, similarity=THRESHOLD).select("query_id", "sample_id", "score", F.col("rank").cast("long").alias("rank"))


@query()
def recognize_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k in the nearest cells of a trained inverted file; its recall and the part that it reads are measured in the tests.

    The neighbours of the test vectors have cosines of 0.35 to 0.5 and are spread over many cells: 0.3 of these are probed.
    """
    index = I.build(gallery(spark, sf_dir), folder(spark))
    return I.search(index, probes(spark, sf_dir), K, probes=max(1, 3 * len(index.centres) // 10)).select("query_id", "sample_id", "score", F.col("rank").cast("long").alias("rank"))


@query(RANKED.format(keep="AND g.label < 5 AND g.vec_id % 2 = 1") + f"SELECT query_id, sample_id, score, rank FROM ranked WHERE rank <= {K}")
def recognize_indexed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all cells of the inverted file probed the search is exact; the filter is applied before the ranking."""
    index = I.build(gallery(spark, sf_dir), folder(spark), rounds=2)
    keep = (F.col("person_id") < 5) & (F.col("sample_id") % 2 == 1)
    return I.search(index, probes(spark, sf_dir), K, len(index.centres), keep).select("query_id", "sample_id", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT vec_id AS sample_id, CAST(label AS BIGINT) AS person_id, CAST(len(embedding) AS BIGINT) AS dim, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 6) + 0.0 AS total FROM embeddings WHERE vec_id IN (3, 77, 140, 199, 1000003)")
def lookup_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and payload of some ids, from a table that lies in the order of its ids."""
    path = folder(spark)
    L.store_by_id(gallery(spark, sf_dir), path, "sample_id")
    total = F.aggregate(V.doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return L.find(spark, path, "sample_id", [3, 77, 140, 199, 1_000_003]).select("sample_id", "person_id", F.size("embedding").cast("long").alias("dim"), (F.round(total, 6) + 0.0).alias("total"))
