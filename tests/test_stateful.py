"""Streams with state: trailing values, first writers, shards that wait for their records."""

import random

import numpy as np
from pyspark.sql import functions as F

from galleria.operators import ingest, metrics
from galleria.plans.ingest import doc_photos
from galleria.streaming import stateful as S


def run(spark, stream, tmp_path, name="out", mode="append"):
    with S.rocksdb(spark):
        stream.writeStream.format("parquet").outputMode(mode).option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def test_trailing_values_with_a_restart(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value").where("user_id < 12")
    rows = [tuple(r) for r in events.orderBy("ts", "event_id").collect()]
    schema = "user_id long, event_id long, ts timestamp, value double"
    cut = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]

    def add(i):
        part = rows[cut[i] : cut[i + 1]]
        random.Random(i).shuffle(part)  # within a batch the order doesn't matter
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    add(0)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = S.trailing(source, 60, 86400, idle_seconds=10**9)
    run(spark, stream, tmp_path)
    add(1)
    add(2)
    got = {r.event_id: r for r in run(spark, stream, tmp_path).collect()}  # goes on with the state of the first run
    assert len(got) == len(rows)
    done = F.row_number().over(metrics.Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rated = metrics.trailing_rate(events.select("event_id", "user_id", F.unix_seconds("ts").alias("s"), done.alias("done")), ["user_id"], "s", "done", 86400)
    for r in rated.collect():
        assert abs(got[r.event_id].rate - r.rate) < 1e-12
    last = metrics.last_n(events, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    for r in last.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e"), F.collect_list("value").alias("v"), F.count("*").alias("n")).collect():
        assert got[r.e].n == r.n and np.allclose([got[r.e].p50, got[r.e].p95], np.quantile(r.v, [0.5, 0.95]))


def test_idle_state_goes(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp, value double"
    for i, second in enumerate((10, 100_000, 100_001, 200_000, 200_001)):
        spark.createDataFrame([(1 + i % 2, i, second, 1.0)], "user_id long, event_id long, s long, value double").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"), "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = {r.event_id: r.n for r in run(spark, S.trailing(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), idle_seconds=3600), tmp_path).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 1}  # user 1 came back twice, after its state had gone; user 2 in time


def test_first_writers_and_rejects(spark, sf, tmp_path):
    photos = doc_photos(spark, sf).select("content", F.col("photo_id").alias("id"), F.timestamp_seconds(F.col("photo_id") + 10).alias("ts"))
    rows = [tuple(r) for r in photos.collect()]
    order = list(range(4))
    random.Random(2).shuffle(order)
    for i in order:
        spark.createDataFrame(rows[i::4], photos.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(photos.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, S.first_writers(source, late="1 day"), tmp_path)
    first = ingest.first_of(doc_photos(spark, sf), ["content"], [F.col("photo_id")])
    assert sorted(r.content for r in got.where("fresh").collect()) == sorted(r.content for r in first.collect())
    assert got.count() == len(rows) and got.where("NOT fresh AND won = id OR fresh AND won <> id").count() == 0
    won = {r.content: r.won for r in got.collect()}
    assert all(r.won == won[r.content] for r in got.collect())


def test_shards_wait_for_their_records(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).withColumns({c: F.timestamp_seconds(c) for c in ("started", "reported") if c in schema}).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name)).schema

    shards = [(1, "a", 5), (1, "b", 5), (1, "c", 10)]
    left = put("p", shards, "job_id long, process_id string, started long")
    right = put("r", [("a", 60, "completed", 5)], "process_id string, reported long, status string, enrolled long")
    stream = S.joined_shards(*(spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for s, n in ((left, "p"), (right, "r"))))
    run(spark, stream, tmp_path)
    put("r", [("c", 90, "failed", 0), ("b", 8000, "completed", 9)], "process_id string, reported long, status string, enrolled long")  # b reports too late
    put("p", [(2, "z", 90_000)], "job_id long, process_id string, started long")
    run(spark, stream, tmp_path)
    put("r", [("z", 90_001, "running", 1)], "process_id string, reported long, status string, enrolled long")
    put("p", [(3, "y", 200_000)], "job_id long, process_id string, started long")
    put("r", [("x", 200_000, "running", 1)], "process_id string, reported long, status string, enrolled long")
    run(spark, stream, tmp_path)
    got = sorted((r.process_id, r.status, r.enrolled) for r in run(spark, stream, tmp_path).collect())
    assert got == [("a", "completed", 5), ("b", "queued", None), ("c", "failed", 0), ("z", "running", 1)]
