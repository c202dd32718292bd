"""Verification statistics over `embeddings`, labels as persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galleria.operators import evaluation as E
from galleria.plans.enrol import staged
from galleria.plans.recognition import gallery
from galleria.plans.registry import query

COSINE = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0"
PAIRS = f"WITH pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(a.label AS BIGINT) AS person_id, {COSINE} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) "
#: Impostors are paired inside hash buckets of about eight samples.
DRAWN = f"""WITH k AS (SELECT *, CAST('0x' || left(md5(CAST(vec_id AS VARCHAR)), 8) AS UBIGINT) % (SELECT greatest(1, count(*) // 8) FROM embeddings) AS k FROM embeddings),
impostors AS (SELECT a.vec_id AS a, b.vec_id AS b, {COSINE} AS score FROM k a JOIN k b ON a.k = b.k AND a.vec_id < b.vec_id AND a.label <> b.label) """
CURVE = DRAWN + f""", pairs AS (SELECT false AS genuine, score FROM impostors UNION ALL SELECT true, {COSINE} FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
t AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(5, 46) AS r(i)),
roc AS (SELECT threshold, CAST(count_if(genuine AND score >= threshold) AS BIGINT) AS tp, CAST(count_if(genuine AND score < threshold) AS BIGINT) AS fn, CAST(count_if(NOT genuine AND score >= threshold) AS BIGINT) AS fp, CAST(count_if(NOT genuine AND score < threshold) AS BIGINT) AS tn FROM pairs, t GROUP BY threshold),
curve AS (SELECT *, tp / (tp + fn) AS tar, fp / (fp + tn) AS far, fn / (tp + fn) AS frr FROM roc) """


def curve(spark: SparkSession, d: str) -> DataFrame:
    """The curve of all genuine pairs and the drawn impostor pairs."""
    g = gallery(spark, d)
    drawn = E.impostor_pairs(g).select(F.lit(False).alias("genuine"), "score")
    return E.curve_of(E.genuine_steps(g, 5, 45).unionByName(E.steps(drawn, 5, 45)), 5, 45)


@query(PAIRS + "SELECT * FROM pairs")
def pairwise_genuine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.genuine_pairs(gallery(spark, sf_dir)).select("a", "b", "person_id", (F.col("score") + 0.0).alias("score"))


POINTS = ", ".join(f"round(quantile_cont(s, 0.{p:02d}), 2) / 1000000 AS p{p}" for p in (5, 25, 50, 75, 95, 99))
DESCRIBED = f"count(*) AS n, round(avg(s), 2) / 1000000 AS mean, round(stddev_pop(s), 2) / 1000000 AS std, min(s) / 1000000 AS min, max(s) / 1000000 AS max, {POINTS}"


def shown(found: DataFrame, by: list[str]) -> DataFrame:
    """Scores have six places; in millionths, interpolated percentiles have two more and none falls on a half."""
    return found.select(*by, "n", *[(F.round(c, 2) / 1000000 + 0.0).alias(c) for c in ("mean", "std", "min", "max", "p5", "p25", "p50", "p75", "p95", "p99")])


@query(PAIRS + f"SELECT person_id, {DESCRIBED} FROM (SELECT person_id, round(score * 1000000) AS s FROM pairs) GROUP BY person_id")
def score_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.describe_genuine(gallery(spark, sf_dir), staged), ["person_id"])


@query(PAIRS + """, both_ways AS (SELECT a AS sample_id, score FROM pairs UNION ALL SELECT b, score FROM pairs) SELECT sample_id, count(*) AS n, round(min(score), 6) AS low, floor(CAST(sum(CAST(round(score * 1000000) AS BIGINT)) AS DOUBLE) / count(*)) / 1000000 AS mean, round(max(score), 6) AS high FROM both_ways GROUP BY sample_id""")
def person_pairwise_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each sample scores against the others of its person."""
    mean = F.floor(F.col("total").cast("double") / F.col("n")) / 1000000
    return E.genuine_by_sample(gallery(spark, sf_dir)).select("sample_id", "n", (F.col("low") / 1000000).alias("low"), mean.alias("mean"), (F.col("high") / 1000000).alias("high"))


@query(CURVE + "SELECT threshold, tp, fn, fp, tn, round(tar, 6) AS tar, round(far, 6) AS far, round(frr, 6) AS frr FROM curve")
def threshold_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curve(spark, sf_dir)
    return rows.select("threshold", "tp", "fn", "fp", "tn", *[F.round(c, 6).alias(c) for c in ("tar", "far", "frr")])


@query(CURVE + "SELECT threshold, round(far, 6) AS far, round(frr, 6) AS frr FROM curve ORDER BY abs(far - frr), threshold LIMIT 1")
def eer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.equal_error(curve(spark, sf_dir)).select("threshold", F.round("far", 6).alias("far"), F.round("frr", 6).alias("frr"))


@query(CURVE + """SELECT * FROM (SELECT 'tar at far' AS rule, threshold, round(tar, 6) AS tar, round(far, 6) AS far FROM curve WHERE far <= 0.01 ORDER BY curve.tar DESC, threshold LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'far at frr', threshold, round(tar, 6), round(far, 6) FROM curve WHERE frr <= 0.9 ORDER BY curve.far, threshold LIMIT 1)""")
def constrained_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(curve(spark, sf_dir))  # asked twice
    both = E.constrained(rows, F.col("far") <= 0.01, F.col("tar"), "tar at far").unionByName(E.constrained(rows, F.col("frr") <= 0.9, -F.col("far"), "far at frr"))
    return both.select("rule", "threshold", F.round("tar", 6).alias("tar"), F.round("far", 6).alias("far"))


@query(DRAWN + f"SELECT {DESCRIBED} FROM (SELECT round(score * 1000000) AS s FROM impostors)")
def impostor_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impostor scores by a fixed draw."""
    return shown(E.describe(E.impostor_pairs(gallery(spark, sf_dir)).withColumn("score", F.round(F.col("score") * 1000000))), [])


@query(DRAWN + """, both_ways AS (SELECT a AS sample_id, score FROM impostors UNION ALL SELECT b, score FROM impostors),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC) AS place, count(*) OVER (PARTITION BY sample_id) AS n FROM both_ways)
  SELECT sample_id, max(n) AS n, max(score) AS largest, max(score) FILTER (WHERE place = floor(n * 0.05) + 1) AS at_share FROM ranked GROUP BY sample_id""")
def top_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's impostor scores: the largest, and the one at a twentieth from the top."""
    rows = E.negative_at(E.impostor_pairs(gallery(spark, sf_dir)))
    return rows.select("sample_id", "n", (F.col("largest") + 0.0).alias("largest"), (F.col("at_share") + 0.0).alias("at_share"))


@query("SELECT vec_id AS sample_id FROM embeddings WHERE label <> 3 ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 100")
def negative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred samples of other persons than one, drawn by a hash."""
    return E.drawn(gallery(spark, sf_dir).where("person_id <> 3")).select("sample_id")
