"""Upserts that touch only changed partitions, rejects and their counts, replays, and jobs with progress."""

import glob
import hashlib
import os
import uuid

import pytest
from pyspark.sql import functions as F

from galleria.operators import quality as Q
from galleria.streaming import process_log as P
from galleria.streaming.keyed_table import KeyedTable, merge_batch, upsert_stream

SCHEMA = "id long, name string, first long, n long"


def table_of(path, parts=8):
    return KeyedTable(str(path), ["id"], ["name", "n"], lambda: [F.desc("n")], parts, lambda: {"name": F.col("name").isNotNull(), "n": F.col("n") >= 0})


def files(path):
    return {f: hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{path}/rows/part=*/*.parquet")}


def rows(table, spark):
    return sorted(tuple(r) for r in table.rows(spark).select("id", "name", "first", "n").collect())


def test_untouched_partitions_stay_byte_for_byte(spark, tmp_path):
    table = table_of(tmp_path / "t")
    first = merge_batch(table, spark.createDataFrame([(i, f"a{i}", i, i) for i in range(100)] + [(7, None, 0, 0), (8, "x", 0, -1), (9, None, 0, -2)], SCHEMA), 0)
    assert first == {"rows": 103, "broken": 3, "name": 2, "n": 2}
    before = files(tmp_path / "t")
    batch = spark.createDataFrame([(5, "b", 500, 1), (5, "c", 501, 2), (1000, "new", 7, 0)], SCHEMA)
    merge_batch(table, batch, 1)
    after = files(tmp_path / "t")
    touched = {r.p for r in batch.select(table.part().alias("p")).collect()}
    same = {f for f in before if int(f.split("part=")[1].split("/")[0]) not in touched}
    assert same and all(after[f] == before[f] for f in same) and len(same) + len(touched) == 8
    want = sorted([(i, f"a{i}", i, i) for i in range(100) if i != 5] + [(5, "c", 5, 2), (1000, "new", 7, 0)])
    assert rows(table, spark) == want
    assert sorted((r.id, r.broken) for r in table.rejected(spark).collect()) == [(7, ["name"]), (8, ["n"]), (9, ["name", "n"])]
    assert merge_batch(table, batch, 1) == {} and rows(table, spark) == want  # it comes again


def test_a_run_that_ended_before_its_partitions_were_in_place_goes_on(spark, tmp_path, monkeypatch):
    table = table_of(tmp_path / "t")
    merge_batch(table, spark.createDataFrame([(i, "a", i, 1) for i in range(20)], SCHEMA), 0)
    batch = spark.createDataFrame([(i, "b", 0, 2) for i in range(10)], SCHEMA)
    merge_batch(table, batch, 1)
    want = rows(table, spark)
    for part in {r.p for r in batch.select(table.part().alias("p")).collect()}:
        for f in glob.glob(f"{tmp_path}/t/rows/part={part}/*.parquet"):
            os.remove(f)  # as if the overwrite had ended between taking the old files away and putting the new ones there
    assert rows(table, spark) != want
    merge_batch(table, batch, 1)
    assert rows(table, spark) == want


def test_vector_points_are_checked_as_they_are_written(spark, tmp_path):
    def point(i, vector, **changes):
        own = str(uuid.UUID(int=i))
        payload = {"sampleId": own, "photoId": own, "personId": own, "active": "true", "modelVersion": "m"} | changes
        return own, {k: v for k, v in payload.items() if v is not None}, vector

    points = [point(1, [1.0, 2.0]), point(2, [0.0, 0.0]), point(3, [float("nan"), 1.0]), point(4, [1.0]), point(5, None), point(6, [1.0, 1.0], photoId="x"), point(7, [1.0, 1.0], email="e"), point(8, [1.0, 1.0], active=None), point(1, [3.0, 4.0])]
    batch = spark.createDataFrame(points, "point_id string, payload map<string,string>, embedding array<double>")
    table = KeyedTable(str(tmp_path / "p"), ["point_id"], ["payload", "embedding"], lambda: [F.desc(F.col("embedding")[0])], 4, lambda: Q.point_rules(2))
    counts = merge_batch(table, batch, 0)
    assert [(r.point_id, r.embedding) for r in table.rows(spark).collect()] == [(points[0][0], [3.0, 4.0])]
    assert (counts["rows"], counts["broken"]) == (9, 7) and {n for n in Q.POINT_FAULTS if counts[n]} == {"zero", "not finite", "dimension", "null", "photoId is no UUID", "other key", "missing key", "active is no boolean"}
    reasons = {r.point_id: set(r.broken) for r in table.rejected(spark).collect()}
    assert reasons[points[1][0]] == {"zero"} and reasons[points[7][0]] == {"missing key", "active is no boolean"}


def test_counts_of_one_scan_equal_the_queries(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    rules = {"value": F.col("value") < 150, "type": F.col("event_type").isin("view", "click")}
    marked, counts = Q.observed(events, rules)
    marked.write.parquet(str(tmp_path / "e"))
    want = Q.violations(events, rules)
    assert counts.get["broken"] == want.count() and counts.get["rows"] == events.count()
    assert {n: counts.get[n] for n in rules} == {n: want.where(F.array_contains("broken", n)).count() for n in rules}
    assert marked._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1


def streamed(spark, tmp_path, n):
    for i in range(n):
        spark.createDataFrame([(k, f"{i}", i, i) for k in range(i, i + 10)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_a_stream_of_batches(spark, tmp_path):
    table, seen = table_of(tmp_path / "t"), {}
    source = streamed(spark, tmp_path, 3)
    upsert_stream(source, table, str(tmp_path / "c"), lambda b, c: seen.update({b: c})).awaitTermination()
    assert len(seen) == 3 and all(c["rows"] == 10 for c in seen.values())
    assert [r[0] for r in rows(table, spark)] == list(range(12))
    once = rows(table, spark)
    upsert_stream(source, table, str(tmp_path / "c2")).awaitTermination()  # everything comes again
    assert rows(table, spark) == once


def test_progress_of_each_batch_and_a_cancelled_job_goes_on(spark, tmp_path):
    table, done = table_of(tmp_path / "t"), []
    source = streamed(spark, tmp_path, 4)
    step = lambda batch, i: merge_batch(table, batch, i)
    assert not P.run_job(source, "enrol", str(tmp_path / "c"), step, done.append, cancelled=lambda: len(done) >= 1, poll=0.05)
    first = len(done)
    assert 1 <= first < 4
    assert P.run_job(source, "enrol", str(tmp_path / "c"), step, done.append)
    assert [d["batch"] for d in done][-1] == 3 and {d["batch"] for d in done} == {0, 1, 2, 3} and all(d["rows"] == 10 and d["job"] == "enrol" for d in done)
    assert [r[0] for r in rows(table, spark)] == list(range(13))


def test_no_table_yet(spark, tmp_path):
    table = table_of(tmp_path / "none")
    assert table.rows(spark) is None and table.rejected(spark) is None
    with pytest.raises(Exception):
        P.run_job(streamed(spark, tmp_path, 1), "bad", str(tmp_path / "c"), lambda b, i: 1 / 0, print)
