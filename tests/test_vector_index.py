"""The inverted file: recall, what it reads, equality with the exact search, additions, hot cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galleria.operators import topk as T, vector_index as I
from galleria.plans import recognition as R


def hits(df):
    return sorted((r.query_id, r.sample_id, r.score, r.rank) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return I.build(R.gallery(spark, "/root/testdata/sf0.1"), str(tmp_path_factory.mktemp("index") / "i"))


def test_recall_with_a_third_of_the_gallery(spark, index):
    queries = R.probes(spark, "/root/testdata/sf0.1")
    probes = 3 * len(index.centres) // 10
    exact = {x[:2] for x in hits(T.topk(queries, R.gallery(spark, "/root/testdata/sf0.1"), 5))}
    found = {x[:2] for x in hits(I.search(index, queries, 5, probes))}
    assert len(exact & found) >= 0.9 * len(exact) and I.scored_share(index, queries, probes) <= 1 / 3
    assert I.scored_share(index, queries, 4) < 0.03


def test_all_cells_are_the_exact_search_also_in_blocks(spark, index, monkeypatch):
    queries, gallery = R.probes(spark, "/root/testdata/sf0.1"), R.gallery(spark, "/root/testdata/sf0.1")
    keep = F.col("person_id") == 3
    exact = hits(T.topk(queries, gallery, 5, keep))
    assert hits(I.search(index, queries, 5, len(index.centres), keep)) == exact
    few = hits(I.search(index, queries, 5, 7))
    monkeypatch.setattr(I, "PROBES_AT_ONCE", 10)
    monkeypatch.setattr(I, "BLOCK", 3)
    assert hits(I.search(index, queries, 5, len(index.centres), keep)) == exact
    assert hits(I.search(index, queries, 5, 7)) == few


def test_only_the_folders_of_probed_cells_are_read(spark, index):
    one = R.probes(spark, "/root/testdata/sf0.1").limit(1)
    plan = I.search(index, one, 5, 2)._jdf.queryExecution().toString()
    assert "folder" in plan.split("PartitionFilters")[1][:120] and "In(cell" in plan.split("PushedFilters")[1][:120]
    files = index.vectors(spark, [3, 5, 40]).select(F.input_file_name().alias("f"), "folder").distinct().collect()
    assert {r.folder for r in files} == {0, 2} and len(files) == 2


def test_an_index_is_found_again_and_takes_more_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist(), i % 3) for i in range(200)]
    make = lambda r: spark.createDataFrame(r, "sample_id long, embedding array<double>, model int")
    path = str(tmp_path / "i")
    index = I.build(make(rows[:150]), path, cells=10)
    more = I.add(index, make(rows[150:] + [(999, [0.0] * 8, 1)]))
    again = I.stored(spark, path)
    assert np.array_equal(again.centres, index.centres) and np.array_equal(again.sizes, more.sizes) and more.sizes.sum() == 201
    queries = make(rows).where("sample_id % 10 = 0").withColumnRenamed("sample_id", "query_id")
    assert hits(I.search(again, queries, 3, 10)) == hits(T.topk(queries, make(rows + [(999, [0.0] * 8, 1)]), 3))


def test_copies_fill_one_cell_and_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "FILE_ROWS", 20)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(150)] + [(i, [0.0, float(i), 1.0]) for i in range(150, 180)]
    gallery = spark.createDataFrame(rows, "sample_id long, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # it would join small files
    try:
        index = I.build(gallery, str(tmp_path / "i"), cells=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.sizes.max() == 150 and index.vectors(spark, [int(index.sizes.argmax())]).select(F.input_file_name()).distinct().count() > 1
    query = spark.createDataFrame([(-1, [1.0, 0.1, 0.0])], "query_id long, embedding array<double>")
    assert [x[1] for x in sorted(hits(I.search(index, query, 5, 1)), key=lambda x: x[3])] == [0, 1, 2, 3, 4]
    assert I.search(index, query.limit(0), 5, 1).count() == 0


def test_wrong_arguments(spark, index, tmp_path):
    one = R.probes(spark, "/root/testdata/sf0.1").limit(1)
    for k, probes in ((0, 1), (21, 1), (5, 0)):
        with pytest.raises(ValueError):
            I.search(index, one, k, probes)
    with pytest.raises(ValueError):
        I.build(R.gallery(spark, "/root/testdata/sf0.001").limit(0), str(tmp_path / "none"))
