import hashlib
import hmac
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from galleria.functions import display as D, geometry as G, identity as I, vectors as V


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_names_and_masks(spark):
    names = ["", "Ada", "Ada Lovelace", "  Anna  Maria   von Berg ", None]
    got = values(spark, I.split_name(F.col("x")), names)
    assert [tuple(g) for g in got[:4]] == [("", ""), ("Ada", ""), ("Ada", "Lovelace"), ("Anna Maria von", "Berg")]
    assert values(spark, I.mask_tail(F.col("x")), ["", "1234", "12345", "12345678901"]) == ["", "****", "*2345", "*******8901"]
    assert values(spark, I.mask_hmac(F.col("x")), ["a" * 64, "123456789012"]) == ["*" * 24 + "a" * 8, "****56789012"]
    assert values(spark, I.sanitize_message(F.col("x")), ["cannot read /data/a/b.jpg now", r"C:\users\x y", "a/b"]) == ["cannot read <path> now", "C:<path> y", "a/b"]


def test_hashes_against_python(spark):
    texts = ["a", "é", "x" * 200, ""]
    for key in ("k", "K" * 100):
        assert values(spark, I.hmac_sha256(F.col("x"), key), texts) == [hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest() for t in texts]
    ns = I.NAMESPACES["person"]
    ids = values(spark, I.uuid5(F.col("x"), ns), texts)
    assert ids == [str(uuid.uuid5(uuid.UUID(ns), t)) for t in texts]
    for n in (1, 2, 7, 100):
        assert values(spark, I.bucket_uuid(F.col("x"), n), ids) == [uuid.UUID(i).int % n for i in ids]
        assert values(spark, I.bucket_sha(F.col("x"), n), ids) == [int.from_bytes(hashlib.sha256(i.encode()).digest()[:8], "big") % n for i in ids]
    with pytest.raises(ValueError):
        I.bucket_sha(F.col("x"), 0)
    seven = values(spark, I.uuid7_like(F.col("x")), [1_700_000_000_000], "x long")[0]
    assert uuid.UUID(seven).int >> 80 == 1_700_000_000_000 and seven[14] == "7"


def test_vectors(spark):
    rows = [[3.0, 4.0], [0.0, 0.0], [float("nan"), 1.0], [1.0]]
    got = values(spark, V.l2_normalize(F.col("x")), rows, "x array<double>")
    assert got[0] == [0.6, 0.8] and got[1] is None and got[2] is None
    assert values(spark, V.l2_normalize(F.col("x"), 1e-12), rows[1:2], "x array<double>") == [[0.0, 0.0]]
    assert values(spark, V.faults(F.col("x"), 2), [*rows, None], "x array<double>") == [[], ["zero"], ["not finite"], ["dimension"], ["null"]]
    assert values(spark, V.cosine(F.col("x"), F.array(F.lit(1.0), F.lit(0.0))), rows[:2], "x array<double>") == [0.6, None]


def test_display(spark):
    assert values(spark, D.similarity_text(F.col("x")), [0.456, 1.7, -1.0, None], "x double") == ["0.46", "1.00", "0.00", "-"]
    assert values(spark, D.margin_text(F.col("x"), F.lit(0.5)), [0.75, 0.25], "x double") == ["+0.25", "-0.25"]
    assert values(spark, D.progress_percent(F.col("x"), F.lit(3)), [0, 1, 3, 9], "x int") == [0, 33, 100, 100]
    assert values(spark, D.progress_percent(F.col("x"), F.lit(0)), [5], "x int") == [0]


def plain_iou(a, b):
    side = lambda p, q: max(0.0, min(a[q], b[q]) - max(a[p], b[p]) + 1)
    inter = side(0, 2) * side(1, 3)
    whole = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1] + 1)
    return inter / (whole(a) + whole(b) - inter)


def test_suppression_against_loops(spark):
    rng = np.random.default_rng(7)
    different = 0
    for _ in range(5):
        xy, wh = rng.uniform(0, 60, (25, 2)), rng.uniform(10, 40, (25, 2))
        boxes = [tuple(map(float, (*p, *(p + s)))) for p, s in zip(xy, wh, strict=True)]
        kind = "x array<struct<x1: double, y1: double, x2: double, y2: double>>"
        kept = []
        for b in boxes:
            if not any(plain_iou(k, b) > 0.4 for k in kept):
                kept.append(b)
        once = [b for i, b in enumerate(boxes) if not any(plain_iou(k, b) > 0.4 for k in boxes[:i])]
        assert [tuple(r) for r in values(spark, G.greedy_nms(F.col("x"), 0.4), [boxes], kind)[0]] == kept
        assert [tuple(r) for r in values(spark, G.one_shot_nms(F.col("x"), 0.4), [boxes], kind)[0]] == once
        different += kept != once
    assert different


def test_anchors_and_transform(spark):
    got = spark.range(1).select(G.anchors(640).alias("a")).first().a
    assert len(got) == 16_800 and [(g.cx, g.cy) for g in got[:4]] == [(0, 0), (0, 0), (8, 0), (8, 0)]
    assert len(spark.range(1).select(G.priors(640).alias("p")).first().p) == 16_800
    angle, scale, shift = np.deg2rad(15), 1.3, np.array([12.0, -8.0])
    turn = scale * np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    moved = (np.array(G.TEMPLATE) - shift) @ np.linalg.inv(turn).T
    t = values(spark, G.similarity_transform(F.col("x")), [moved.tolist(), [[1.0, 1.0]] * 5], "x array<array<double>>")
    assert np.allclose([t[0].a, t[0].b, t[0].tx, t[0].ty], [turn[0, 0], turn[1, 0], *shift], atol=1e-3) and t[1] is None
