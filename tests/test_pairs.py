"""Scores of all pairs of a person in blocks: against a plain join, odd vectors, many samples in little time."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from galleria.functions.vectors import cosine
from galleria.operators import evaluation as E


def plain_pairs(samples):
    x = samples.select(F.col("sample_id").alias("a"), "person_id", F.col("embedding").alias("u"))
    y = samples.select(F.col("sample_id").alias("b"), "person_id", F.col("embedding").alias("v"))
    return x.join(y, "person_id").where("a < b").select("a", "b", "person_id", F.round(cosine(F.col("u"), F.col("v")), 6).alias("score"))


def rows_of(df):
    return sorted(str(tuple(round(v, 3) + 0.0 if isinstance(v, float) else v for v in r)) for r in df.collect())


@pytest.fixture(scope="module")
def samples(spark):
    """Copies, opposites, halves of a millionth, zero and null vectors, other dimensions, repeated ids, persons of one sample."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, rng.standard_normal(6).tolist()) for i in range(150)]
    rows += [(200 + i, 0, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(5)] + [(210, 0, [-1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (211, 0, [0.1234565, (1 - 0.1234565**2) ** 0.5, 0.0, 0.0, 0.0, 0.0])]
    rows += [(220, 1, [0.0] * 6), (221, 1, None), (222, 1, [1.0, 2.0]), (223, 1, [2.0, 1.0]), (224, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (225, 1, []), (5, 2, [1.0] * 6)]
    rows += [(230, 7, [1.0] * 6), (231, None, [1.0] * 6), (232, None, [1.0] * 6), (None, 0, [1.0] * 6), (240, 8, [0.0]), (241, 8, [0.0])]
    return spark.createDataFrame(rows, "sample_id long, person_id long, embedding array<double>")


@pytest.fixture(params=[4096, 20])
def block(request, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", request.param)


def test_pairs(samples, block):
    assert sorted(map(str, E.genuine_pairs(samples).select("a", "b", "person_id", F.col("score") + 0.0).collect())) == sorted(map(str, plain_pairs(samples).select("a", "b", "person_id", F.col("score") + 0.0).collect()))


def test_by_sample(samples, block):
    pairs = plain_pairs(samples).select(F.explode(F.array("a", "b")).alias("sample_id"), F.round(F.col("score") * 1000000).cast("long").alias("s"))
    assert rows_of(E.genuine_by_sample(samples)) == rows_of(pairs.groupBy("sample_id").agg(F.count("*"), F.min("s"), F.sum("s"), F.max("s")))


def test_described(samples, block):
    want = E.describe(plain_pairs(samples).withColumn("score", F.round(F.col("score") * 1000000)), by=["person_id"])
    assert rows_of(E.describe_genuine(samples)) == rows_of(want)


def test_steps(samples, block):
    want = E.steps(plain_pairs(samples).withColumn("genuine", F.lit(True)), 5, 45)
    assert rows_of(E.genuine_steps(samples, 5, 45)) == rows_of(want)


def test_text_ids_and_vectors_that_are_not_finite(spark):
    rows = [("x", "p", [1.0, 0.0]), ("y", "p", [float("nan"), 1.0]), ("z", "p", [1.0, 1.0]), ("a", "p", [float("inf"), 1.0])]
    samples = spark.createDataFrame(rows, "sample_id string, person_id string, embedding array<double>")
    assert rows_of(E.genuine_pairs(samples)) == rows_of(plain_pairs(samples))
    r = E.describe_genuine(samples).first()
    assert r.n == 6 and r.min == 707107 and all(np.isnan(v) for v in (r.mean, r.std, r.max, r.p50))


def test_a_person_of_many_samples_takes_little_time(spark):
    """18 million pairs; a join with array expressions took minutes for a tenth of them."""
    samples = spark.range(6000).select(F.col("id").alias("sample_id"), F.lit(1).alias("person_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: F.sin(x * 1.7 + F.col("id") * x).cast("float")).alias("embedding"))
    began = time.monotonic()
    assert E.describe_genuine(samples).first().n == 6000 * 5999 // 2
    assert E.genuine_steps(samples, 5, 45).agg(F.sum("g")).first()[0] == 6000 * 5999 // 2
    assert E.genuine_by_sample(samples).agg(F.sum("n")).first()[0] == 6000 * 5999
    assert E.genuine_pairs(samples).agg(F.count("*")).first()[0] == 6000 * 5999 // 2
    assert time.monotonic() - began < 120
