import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from galleria.operators import boxes as B, enrol as N, evaluation as E, extract, ingest as I, jobs as J, manifest as M, metrics, people as P, quality as Q, topk as T
from galleria.plans import enrol as enrol_plans
from galleria.sources import readers, schemas, settings
from galleria.streaming import process_log, run


def vectors(spark, n=300, dim=16, seed=1):
    m = np.random.default_rng(seed).standard_normal((n, dim))
    return m, spark.createDataFrame([(i, i % 7, [float(x) for x in v]) for i, v in enumerate(m)], "sample_id long, person_id long, embedding array<double>")


def test_topk_in_blocks(spark, monkeypatch):
    m, gallery = vectors(spark)
    queries = gallery.select(F.col("sample_id").alias("query_id"), "embedding").where("query_id % 3 = 0")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    np.fill_diagonal(scores, -9)
    want = {(q, int(s), r + 1) for q in range(0, 300, 3) for r, s in enumerate(np.lexsort((np.arange(300), -scores[q]))[:4])}
    monkeypatch.setattr(T, "BLOCK", 40)
    for most in (20_000, 40):  # sent to the gallery, or in cells of blocks
        monkeypatch.setattr(T, "PROBES_AT_ONCE", most)
        assert {(r.query_id, r.sample_id, r["rank"]) for r in T.topk(queries, gallery, 4).collect()} == want
    with pytest.raises(ValueError):
        T.topk(queries, gallery, 21)


def test_approximate_topk_recall(spark):
    m, _ = vectors(spark)
    near = m + 0.15 * np.random.default_rng(2).standard_normal(m.shape)
    rows = [(i, i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([m, near]))]
    gallery = spark.createDataFrame(rows, "sample_id long, person_id long, embedding array<double>")
    queries = gallery.select(F.col("sample_id").alias("query_id"), "embedding").where("query_id % 20 = 0")
    exact = {(r.query_id, r.sample_id) for r in T.topk(queries, gallery, 1).collect()}
    found = {(r.query_id, r.sample_id) for r in T.approximate_topk(queries, gallery, 16, 1).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_no_candidates_is_unknown(spark):
    _, gallery = vectors(spark, 5)
    queries = gallery.select(F.col("sample_id").alias("query_id"), "embedding")
    people = spark.createDataFrame([(0, "Zoe")], "person_id long, name string")
    rows = T.recognize(queries, gallery, people, keep=F.lit(False)).collect()
    assert len(rows) == 5 and {r.status for r in rows} == {"unknown"}


def test_mutations_twice_give_the_same(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, owner string, mime string")
    new = spark.createDataFrame([(2, "c", "z", 0), (3, "d", "w", 1), (3, "e", "v", 2), (2, "f", "u", 3)], "id long, owner string, mime string, n long")
    once = I.upsert(old, new, ["id"], ["owner"], [F.col("n")])
    assert sorted(map(tuple, once.collect())) == [(1, "a", "x"), (2, "c", "y"), (3, "d", "w")]
    assert sorted(map(tuple, I.upsert(once, new, ["id"], ["owner"], [F.col("n")]).collect())) == sorted(map(tuple, once.collect()))
    kept = I.insert_ignore(old, new, ["id"], [F.col("n")])
    assert sorted(map(tuple, kept.collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "d", "w")]
    assert I.append_strict(old, new.drop("n"), ["id"])[1].count() == 4
    with pytest.raises(Exception, match="numbers of files"):
        I.zipped(spark.createDataFrame([(1, [1, 2])], "key int, a array<int>"), spark.createDataFrame([(1, [1])], "key int, b array<int>"), "a", "b").collect()


def test_rejects_keep_their_index(spark):
    rows = [(0, "A B", "1", 5), (1, "", "2", 5), (2, "C", None, 5), (3, "D", "4", 0)]
    good, bad = I.validated(spark.createDataFrame(rows, "index int, name string, national_id string, length int"))
    assert [r["index"] for r in good.collect()] == [0]
    assert sorted(map(tuple, bad.collect())) == [(1, "missing name"), (2, "missing national id"), (3, "empty image")]


def test_payload_rejects(spark):
    uid = "0190a1b2-0000-7000-8000-00000000000a"
    good = {"sampleId": uid, "photoId": uid, "personId": uid, "active": "true", "modelVersion": "m"}
    cases = [(good, uid, [1.0, 0.0]), ({**good, "name": "x"}, uid, [1.0, 0.0]), ({k: v for k, v in good.items() if k != "modelVersion"}, uid, [1.0, 0.0]), (good, "other", [1.0, 0.0]), ({**good, "personId": "1"}, uid, [1.0, 0.0]), (good, uid, [1.0]), (good, uid, [float("nan"), 1.0]), (good, uid, [0.0, 0.0])]
    frame = spark.createDataFrame(cases, "p map<string, string>, id string, v array<double>")
    got = [r[0] for r in frame.select(Q.payload_faults(F.col("p"), F.col("id"), F.col("v"), 2)).collect()]
    assert got == [[], ["other key"], ["missing key", "no model version"], ["id differs"], ["personId is no UUID"], ["dimension"], ["not finite"], ["zero"]]
    vector = spark.createDataFrame([], schemas.TABLES["sample_vector"]).schema
    assert Q.personal_columns(vector) == [] and Q.personal_columns(spark.createDataFrame([], schemas.TABLES["person"]).schema)
    assert Q.schema_differences(vector, spark.createDataFrame([], "sample_id string, x int").schema)[-1].startswith("unknown")


def test_job_rules(spark):
    rows = [(False, 0, 0, 0, 100), (False, 0, 2, 0, 100), (False, 0, 3, 1, 100), (True, 0, 0, 0, 0), (False, 1, 0, 0, 9)]
    frame = spark.createDataFrame(rows, "fatal boolean, failed long, no_face long, decode long, discovered long")
    got = [r[0] for r in frame.select(J.outcome(*[F.col(c) for c in frame.columns])).collect()]
    assert got == ["completed", "completed_with_warnings", "failed", "failed", "failed"]
    shards = spark.createDataFrame([([(0, "failed"), (1, "running")],)], "s array<struct<shard_index: int, status: string>>")
    again = shards.select(J.resumed(F.col("s"), F.lit("k")).alias("s")).first().s
    assert [(x.status, x.after_key) for x in again] == [("queued", "k"), ("running", None)]
    assert shards.select(J.replace_shard(F.col("s"), F.lit(1), F.lit("completed")).alias("s")).first().s[1].status == "completed"
    outputs = spark.createDataFrame([("d", 4, 12800, 1), ("d", 4, 12800, 4), ("d", 4, 12800, 10), ("r", 4, 1, 512), ("u", 2, 1, 512)], "model string, input_rank int, count int, channels int")
    assert {r.model: r.kind for r in J.model_kinds(outputs).collect()} == {"d": "detector", "r": "recognizer", "u": "unknown"}


def test_photo_trees_and_extraction(spark, tmp_path):
    for folder, names in {"Person_A": ["1.jpg", "2.JPG", "3.png"], "Person_B": ["1.jpeg", "2.webp"], "Empty": ["x.txt"]}.items():
        (tmp_path / folder).mkdir()
        for name in names:
            (tmp_path / folder / name).write_bytes(f"{folder}{name}".encode())
    got = {r.identity_key: (r.display_name, r.photos) for r in readers.load(spark, "local_lfw", str(tmp_path)).collect()}
    assert got == {"lfw:Person_A": ("Person A", ["1.jpg", "2.JPG", "3.png"]), "lfw:Person_B": ("Person B", ["1.jpeg"])}
    assert {r.photo_count for r in readers.load(spark, "local_vggface", str(tmp_path)).collect()} == {3, 2}
    assert tuple(readers.preflight(spark, str(tmp_path), "vggface").first())[:3] == (2, 5, 1)
    assert readers.load(spark, "synthetic", 4, 3).count() == 4
    assert readers.load(spark, "manifest", json.dumps([{"identity_key": "k", "display_name": "K", "photos": ["a", "b"]}])).first().photo_count == 2
    with pytest.raises(ValueError):
        readers.load(spark, "nothing")
    photos = readers.files(spark, str(tmp_path), content=True).select("path", "content")
    faces = extract.extract(photos, "path").collect()
    assert len(faces) == 6 and all(len(f.embedding) == 512 for f in faces)
    assert sorted(map(str, faces)) == sorted(map(str, extract.extract(photos, "path").collect()))


def test_shards_are_complete_and_stable(spark):
    rows = readers.load(spark, "synthetic", 200, 1)
    for how in ("sha", "uuid"):
        shards = M.sharded(rows, 3, how)
        counts = {r.shard: r["count"] for r in shards.groupBy("shard").count().collect()}
        assert sum(counts.values()) == 200 and set(counts) == {0, 1, 2}
        assert shards.exceptAll(M.sharded(rows, 3, how)).isEmpty()


def test_listing_limits(spark):
    with pytest.raises(ValueError):
        P.list_persons(None, None, None, limit=0)


def test_settings(spark):
    spark.conf.set("spark.galleria.threshold", "0.4")
    assert settings.settings(spark).threshold == 0.4 and settings.settings(spark).embedding_dim == 512
    spark.conf.unset("spark.galleria.threshold")


def test_stream_state_machine(spark, tmp_path):
    rows = [(p, i, s) for p in range(3) for i, s in enumerate(["queued", "running", "queued", "completed", "running"])]
    spark.createDataFrame(rows, "process_id long, sequence long, status string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("process_id long, sequence long, status string").parquet(str(tmp_path / "in"))
    got = sorted((r.process_id, r.sequence, r.before, r.after, r.valid) for r in run.appended(process_log.checked_transitions(stream)).collect())
    want = [("pending", "queued", True), ("queued", "running", True), ("running", "queued", False), ("running", "completed", True), ("completed", "running", False)]
    assert got == [(p, i, *w) for p in range(3) for i, w in enumerate(want)]


def events(spark, path, rows):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(minutes=m), u, "view", 1.0, "{}") for i, m, u in rows], schema).coalesce(1).write.mode("append").parquet(path)


def keep_first(existing, batch):
    rows = batch.select("user_id", "event_id")
    return rows if existing is None else existing.unionByName(rows.join(existing, "event_id", "left_anti").select("user_id", "event_id"))


def test_replayed_batches_add_what_is_new(spark, tmp_path):
    source, target = str(tmp_path / "events"), str(tmp_path / "target")
    run_once = lambda checkpoint: process_log.upsert_each_batch(process_log.read_events(spark, source), target, str(tmp_path / checkpoint), keep_first).awaitTermination()
    assert process_log.current(spark, target) is None
    events(spark, source, [(1, 0, 7), (2, 1, 7)])
    run_once("a")
    run_once("a")  # nothing new
    assert process_log.current(spark, target).count() == 2
    events(spark, source, [(3, 2, 8)])
    run_once("b")  # the checkpoint is lost: batch 0 comes again, with more rows
    assert {r.event_id for r in process_log.current(spark, target).collect()} == {1, 2, 3}
    (tmp_path / "target" / "v=9").mkdir()  # a version that wasn't finished
    events(spark, source, [(4, 3, 8)])
    run_once("b")
    assert {r.event_id for r in process_log.current(spark, target).collect()} == {1, 2, 3, 4}
    assert len(process_log.versions(spark, target)) == 2  # older ones are gone


def test_cancel_between_batches(spark, tmp_path):
    source, seen = str(tmp_path / "events"), []
    for i in range(4):
        events(spark, source, [(i, i, i)])
    stream = lambda: process_log.read_events(spark, source, files_per_trigger=1)
    step = lambda batch, n: seen.append((n, [r.event_id for r in batch.collect()]))
    assert not process_log.cancellable(stream(), str(tmp_path / "c"), step, lambda: len(seen) == 2)
    assert len(seen) == 2
    assert process_log.cancellable(stream(), str(tmp_path / "c"), step, lambda: False)
    assert sorted(e for _, es in seen for e in es) == [0, 1, 2, 3] and [n for n, _ in seen] == [0, 1, 2, 3]


def test_write_once_goes_on(spark, tmp_path):
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    for n in (2, 3):
        events(spark, source, [(10 * n + i, i, 1) for i in range(n)])
        process_log.write_once(process_log.read_events(spark, source).select("event_id"), out, str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(out).count() == {2: 2, 3: 5}[n]


def test_sessions_and_sliding_windows(spark, tmp_path):
    source = str(tmp_path / "events")
    events(spark, source, [(1, 0, 1), (2, 10, 1), (3, 60, 1), (4, 5, 2)])
    out = run.complete(process_log.sessions(process_log.read_events(spark, source)))
    assert sorted((r.user_id, r.n) for r in out.collect()) == [(1, 1), (1, 2), (2, 1)]
    sliding = run.complete(process_log.windowed(process_log.read_events(spark, source), size="1 hour", slide="30 minutes"))
    assert sorted((r.start.hour * 60 + r.start.minute, r.n) for r in sliding.collect()) == [(0, 3), (30, 1), (60, 1), (1410, 3)]


def test_exact_percentiles_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in rng.normal(size=30_000)] + [("b", float(x)) for x in rng.integers(0, 3, 5000)] + [("c", 1.5), (None, 2.0), (None, 4.0), ("d", None)]
    points = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: r for r in metrics.exact_percentiles(frame, ["k"], "v", points).collect()}
    for k in ("a", "b", "c", None):
        own = np.array([v for x, v in rows if x == k])
        assert got[k].n == len(own) and np.allclose([got[k][f"p{round(p * 100):02d}"] for p in points], np.quantile(own, points), atol=1e-12)
    assert got["d"].n == 0 and got["d"].p50 == 0.0
    whole = metrics.exact_percentiles(frame, [], "v", [0.5]).first()
    assert np.isclose(whole.p50, np.quantile([v for _, v in rows if v is not None], 0.5))


def test_impostors_are_of_different_persons(spark):
    _, gallery = vectors(spark, 200)
    person = {r.sample_id: r.person_id for r in gallery.collect()}
    pairs = E.impostor_pairs(gallery).collect()
    assert pairs and all(p.a < p.b and person[p.a] != person[p.b] for p in pairs) and len({(p.a, p.b) for p in pairs}) == len(pairs)
    assert sorted(map(tuple, E.impostor_pairs(gallery).collect())) == sorted(map(tuple, pairs))
    assert len(pairs) < 8 * 200


def test_objects_and_tables(spark):
    objects = spark.createDataFrame([("a", b"1"), ("b", b"2")], "object_key string, content binary")
    keys = spark.createDataFrame([("a",), ("z",), ("a",)], "object_key string")
    assert {r.object_key: r.content for r in readers.read_object(objects, keys).collect()} == {"a": b"1", "z": None}
    assert sorted((r.object_key, r.found) for r in readers.existing_objects(objects, keys).collect()) == [("a", True), ("a", True), ("z", False)]
    again = N.put_objects(objects, spark.createDataFrame([("b", b"3"), ("c", b"4"), ("c", b"4")], "object_key string, content binary"))
    assert {r.object_key: bytes(r.content) for r in again.collect()} == {"a": b"1", "b": b"3", "c": b"4"} and again.count() == 3
    assert [r.object_key for r in N.delete_objects(again, keys).orderBy("object_key").collect()] == ["b", "c"]
    objects.createOrReplaceTempView("some_objects")
    assert Q.missing_tables(spark, ["some_objects", "no_such_table"]) == ["no_such_table"]
    empty, counts = N.reset({"person": objects, "face_sample": objects, "other": objects})
    assert [(r.name, r.n) for r in counts.orderBy("place").collect()] == [("face_sample", 2), ("person", 2), ("other", 2)] and all(t.isEmpty() for t in empty.values())


def test_best_match_and_elapsed(spark):
    box = "image int, id int, box struct<x1: double, y1: double, x2: double, y2: double>"
    left = spark.createDataFrame([(1, 1, (0.0, 0.0, 9.0, 9.0)), (1, 2, (50.0, 50.0, 60.0, 60.0)), (2, 3, (0.0, 0.0, 9.0, 9.0))], box)
    right = spark.createDataFrame([(1, 7, (0.0, 0.0, 9.0, 9.0)), (1, 8, (5.0, 0.0, 14.0, 9.0)), (1, 6, (0.0, 0.0, 9.0, 9.0))], box)
    assert {r.left_id: (r.right_id, r.iou) for r in B.best_match(left, right, "image").collect()} == {1: (6, 1.0), 2: (None, None), 3: (None, None)}
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t, t + timedelta(seconds=5), t + timedelta(seconds=90)), (t, None, t + timedelta(seconds=90)), (t, None, t - timedelta(seconds=9)), (None, None, t)], "s timestamp, c timestamp, a timestamp")
    assert [r[0] for r in rows.select(J.elapsed(F.col("s"), F.col("c"), F.col("a"))).collect()] == [5.0, 90.0, 0.0, 0.0]


def test_shards_of_parents(spark):
    parents = spark.createDataFrame([(1, [(0,), (1,)]), (2, [])], "job_id long, shards array<struct<shard_index: int>>")
    ids = {r.shard_index: r.process_id for r in J.with_shards(parents, spark.createDataFrame([], "process_id string, status string")).collect()}
    records = spark.createDataFrame([(ids[1], "running")], "process_id string, status string")
    assert sorted((r.job_id, r.shard_index, r.status) for r in J.with_shards(parents, records).collect()) == [(1, 0, "queued"), (1, 1, "running")]


def test_events_requests_and_splits(spark):
    log = spark.createDataFrame([("p", 1, "queued"), ("p", 2, "running")], "process_id string, sequence long, after string")
    new = spark.createDataFrame([("p", "status", "failed", None, 1), ("q", "status", "queued", "m", 1), ("q", "status", "running", "n", 2)], "process_id string, event_type string, after string, message string, n int")
    got = sorted((r.process_id, r.sequence, r.before or "", r.after) for r in J.append_events(log, new, ["n"]).collect())
    assert got == [("p", 3, "running", "failed"), ("q", 1, "", "queued"), ("q", 2, "queued", "running")]
    assert J.append_events(log.limit(0), new.limit(0), ["n"]).isEmpty()
    asked = spark.createDataFrame([("a",), ("a",), ("b",)], "idempotency_key string")
    none = spark.createDataFrame([], "process_id string, status string, result string")
    first = {r.idempotency_key: r.process_id for r in J.to_run(asked, none).where("run").collect()}
    stored = spark.createDataFrame([(first["a"], "failed", "why"), (first["b"], "running", "no")], none.schema)
    assert {r.idempotency_key: (r.run, r.result) for r in J.to_run(asked, stored).collect()} == {"a": (False, "why"), "b": (True, None)}
    rows = spark.range(7).select(J.split_by(F.col("id"), 3).alias("x"), J.split_by(F.col("id"), 3, F.lit(7)).alias("y")).collect()
    assert [r.x for r in rows] == [0, 1, 2, 0, 1, 2, 0] and [r.y for r in rows] == [0, 0, 0, 1, 1, 2, 2]
    with pytest.raises(ValueError):
        J.split_by(F.col("id"), 0)


def test_enrolment(spark):
    empty = enrol_plans.empty(spark)
    items = "index long, name string, national_id string, length long, content string, details string"
    box = "index long, ordinal int, box struct<x1: double, y1: double, x2: double, y2: double>, landmarks array<array<double>>, embedding array<double>, score double"
    faces = spark.createDataFrame([(i, k, (0.0, 0.0, 5.0 + (k == i % 2), 5.0), [], [float(k)], 0.9) for i in range(8) if i != 5 for k in (0, 1)], box)
    rows = [(0, "Ada Lovelace", "11111", 3, "x", "first"), (1, "Ada King", "11111", 3, "y", None), (2, "Ada Again", "11111", 3, "x", "lost"), (3, "Bob", "2", 3, "x", None), (4, "", "3", 3, "z", None), (5, "No Face", "4", 3, "z", None), (6, "Eve", "5", 0, "z", None), (7, "Bob Late", "2", 3, "w", "given")]
    frame = spark.createDataFrame(rows, items)
    after, records, errors = N.enrol(empty, frame, faces, "key")
    assert {r["index"]: r.message for r in errors.collect()} == {2: N.DUPLICATE, 4: "missing name", 5: N.NO_FACE, 6: "empty image"}
    assert sorted(r["index"] for r in records.collect()) == [0, 1, 3, 7]
    people = {r.masked: (r.first_name, r.last_name, r.details) for r in after.persons.collect()}
    assert people == {"*1111": ("Ada", "King", "first"), "*": ("Bob", "Late", "given")}
    assert after.identities.count() == 2 and after.photos.count() == after.samples.count() == after.vectors.count() == 4
    assert {r.embedding[0] for r in after.vectors.join(records.where("index = 1"), "photo_id").collect()} == {1.0}
    twice, none, again = N.enrol(after, frame, faces, "key")  # the batch comes again: only conflicts, nothing changes
    assert none.isEmpty() and again.count() == 8 and twice.photos.count() == 4
    assert sorted(map(str, twice.persons.collect())) == sorted(map(str, after.persons.collect()))
    strict, kept, refused = N.enrol(after, spark.createDataFrame([(0, "Ada", "11111", 1, "q", None), (1, "New One", "9", 1, "q", None), (2, "New Two", "9", 1, "r", None)], items), faces, "key", known_persons="reject")
    assert [r["index"] for r in kept.collect()] == [1] and {r["index"]: r.message for r in refused.collect()} == {0: N.KNOWN_PERSON, 2: N.KNOWN_PERSON}
    assert strict.persons.where("first_name = 'Ada' AND last_name = 'King'").count() == 1
    face = after.persons.where("first_name = 'Bob'").first()
    photos = spark.createDataFrame([(0, face.identity_id, 3, "x"), (1, face.identity_id, 3, "new"), (2, "nobody", 3, "new"), (3, face.identity_id, 0, "n"), (5, face.identity_id, 3, "m")], "index long, identity_id string, length long, content string")
    more, added, bad = N.add_photos(after, photos, faces)
    assert [r["index"] for r in added.collect()] == [1] and {r["index"]: r.message for r in bad.collect()} == {0: N.DUPLICATE, 2: N.NO_PERSON, 3: "empty image", 5: N.NO_FACE}
    new = added.first().photo_id
    asked = spark.createDataFrame([(face.identity_id, new), (face.identity_id, "no such"), ("nobody", new)], "identity_id string, photo_id string")
    gone, unknown = N.delete_photos(more, asked, F.lit("2024-01-01").cast("timestamp"))
    assert unknown.count() == 2 and gone.photos.where("status = 'deleted' AND deleted_at IS NOT NULL").count() == 1
    assert [r.photo_id for r in gone.vectors.where("NOT active").collect()] == [new]
    assert N.live_samples(gone, gone.persons.where("first_name = 'Bob'")).count() == 2
    with pytest.raises(ValueError):
        N.enrol(empty, frame, faces, "key", known_persons="maybe")
    vectors = [[1.0, 2.0], [1.0], [0.0, 0.0], [float("nan"), 1.0], [3.0, 4.0]]
    seen = spark.createDataFrame([(i, 0, (0.0, 0.0, 5.0, 5.0), [], v, 0.9) for i, v in enumerate(vectors)], box)
    checked, good, wrong = N.enrol(empty, spark.createDataFrame([(i, "A B", str(i % 4), 3, "x", None) for i in range(5)], items), seen, "key", dim=2)
    assert [r["index"] for r in good.collect()] == [0] and {r["index"]: r.message for r in wrong.collect()} == {1: "vector: dimension", 2: "vector: zero", 3: "vector: not finite", 4: N.DUPLICATE}
    assert [r.embedding for r in checked.vectors.collect()] == [[1.0, 2.0]]


def test_vggface_tree_in_shards(spark, tmp_path):
    for i in range(30):
        folder = tmp_path / "faces" / f"n{i:03d}"
        folder.mkdir(parents=True)
        for k in range(1 + i % 3):
            (folder / f"{k}.webp").write_bytes(b"" if i == 4 else b"x")
    (tmp_path / "readme.txt").write_text("no photo")
    load = lambda **k: readers.load(spark, "local_vggface", str(tmp_path), **k).collect()
    every = [r.identity_key for r in load()]
    assert len(every) == 29  # the folder of an empty file has no photo
    parts = [[r.identity_key for r in load(shard=i, shards=3)] for i in range(3)]
    assert sorted(sum(parts, [])) == sorted(every) and all(parts)
    assert sum(r.photo_count for r in load(max_photos=10)) == 10 and len(load(max_identities=4)) == 4
    assert min(r.identity_key for r in load(after="vggface:n010")) == "vggface:n011"
    with pytest.raises(ValueError):
        load(shard=3, shards=3)
    found = readers.preflight(spark, str(tmp_path / "faces"), "vggface")
    row = found.first()
    assert (row.identities, row.photos, row.corrupt) == (29, 58, 1)
    assert found.select(readers.is_current(F.col("newest"), F.col("newest")), readers.is_current(F.lit("2000-01-01").cast("timestamp"), F.col("newest")), readers.is_current(F.lit(None).cast("timestamp"), F.col("newest"))).first()[:] == (True, False, False)


def test_bad_manifest_is_an_error(spark):
    with pytest.raises(Exception, match="(?i)malformed|JSON"):
        readers.load(spark, "manifest", "[{]").collect()
