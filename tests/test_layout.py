"""Lookups that read few rows, joins that move none, and small rules that no query reaches."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from galleria.functions import geometry as G, vectors as V
from galleria.operators import boxes as B, layout as L, people as P
from galleria.plans import people as PP
from galleria.sources import readers as R
from test_functions import plain_iou


def scanned(df):
    """Rows that the scan of a plan without shuffles has handed on."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_read_few_row_groups(spark, tmp_path):
    rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("sample_id"), F.col("id").alias("n"), F.array_repeat(F.col("id").cast("double"), 16).alias("embedding"))
    path = str(tmp_path / "t")
    L.store_by_id(rows, path, "sample_id", 64 << 10)
    groups = sum(pq.ParquetFile(f).num_row_groups for f in glob.glob(f"{path}/*.parquet"))
    ids = [r.sample_id for r in rows.where("n IN (5, 12345)").collect()] + ["nobody", "0" * 64]
    found = L.find(spark, path, "sample_id", ids)
    assert sorted(r.n for r in found.collect()) == [5, 12345] and groups > 10
    assert scanned(found) < 40_000 / 4
    assert L.find(spark, path, "sample_id", ids, ["n"]).columns == ["n"] and L.find(spark, path, "sample_id", []).count() == 0


def test_a_bucketed_listing_moves_no_rows(spark, sf, tmp_path):
    persons, identities, photos = PP.three(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = [L.store_by_person(df, str(tmp_path / n), f"layout_{n}", buckets=4) for df, n in ((persons, "persons"), (photos, "photos"))]
        listed = P.photo_counts(kept[0], F.broadcast(identities), kept[1])
        rows = sorted(tuple(r) for r in listed.select(*PP.COLUMNS).collect())
        assert "Exchange hashpartitioning" not in listed._jdf.queryExecution().executedPlan().toString()
        assert rows == sorted(tuple(r) for r in P.photo_counts(persons, identities, photos).select(*PP.COLUMNS).collect()) and rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in ("persons", "photos"):
            spark.sql(f"DROP TABLE IF EXISTS layout_{n}")


def test_casia_tree(spark, tmp_path):
    for folder, name in (("0000045", "001.jpg"), ("0000045", "002.PNG"), ("0000099", "001.jpeg"), ("0000099", "readme.txt"), ("0000100", "x.webp")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(b"x")
    rows = R.READERS["local_casia"](spark, str(tmp_path)).orderBy("identity_key").collect()
    assert [(r.identity_key, r.display_name, r.photo_count) for r in rows] == [("0000045", "0000045", 2), ("0000099", "0000099", 1)]


def test_overlap_without_the_extra_one(spark):
    pairs = [((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 15.0, 15.0), 25 / 175), ((0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 2.0, 1.0), 0.0), ((3.0, 3.0, 3.0, 3.0), (3.0, 3.0, 3.0, 3.0), 0.0)]
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    for a, b, want in pairs:
        row = spark.createDataFrame([(a, b)], f"a {box}, b {box}").select(G.iou(F.col("a"), F.col("b"), inclusive=False), G.iou(F.col("a"), F.col("b"))).first()
        assert abs(row[0] - want) < 1e-12 and abs(row[1] - plain_iou(a, b)) < 1e-12


def test_dot_of_unequal_and_null_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -4.0]), ([0.5], [2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.dot(F.col("a"), F.col("b"))).collect()] == [-5.0, 1.0, None]


def test_only_the_best_two_thousand_boxes_of_an_image_are_candidates(spark):
    rows = spark.range(2600).select(F.lit(1).alias("image"), "id", (0.5 + F.col("id") / 10_000).alias("score"), F.lit(None).alias("box"))
    kept = B.candidates(rows.unionByName(spark.range(3).select(F.lit(2).alias("image"), "id", F.lit(0.9).alias("score"), F.lit(None).alias("box"))), "image")
    counts = {r["image"]: (r["n"], r["low"]) for r in kept.groupBy("image").agg(F.count("*").alias("n"), F.min("id").alias("low")).collect()}
    assert counts == {1: (2000, 600), 2: (3, 0)}
