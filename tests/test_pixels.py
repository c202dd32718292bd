"""Warps, padding and planes against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galleria.functions import pixels as P

T = "t struct<a:double,b:double,tx:double,ty:double>"


def plain_warp(image, t, h, w):
    a, b, tx, ty = t
    square, out = a * a + b * b, np.zeros((h, w, image.shape[2]))
    for y in range(h):
        for x in range(w):
            sx, sy = ((a * (x - tx) + b * (y - ty)) / square, (a * (y - ty) - b * (x - tx)) / square) if square > 0 else (0.0, 0.0)
            left, top = math.floor(sx), math.floor(sy)
            for dy in (0, 1):
                for dx in (0, 1):
                    if 0 <= top + dy < image.shape[0] and 0 <= left + dx < image.shape[1]:
                        out[y, x] += image[top + dy, left + dx] * (sx - left if dx else 1 - sx + left) * (sy - top if dy else 1 - sy + top)
    return out


@pytest.mark.parametrize("t", [(1, 0, 0, 0), (1, 0, 2, -1), (0.5, 0.5, 1.25, 2), (-1, 0, 3, 4), (0, 0, 1, 1), (1e-9, 0, 5, 5), (1, 0, -0.25, 0.75), (3, -2, 1e15, 0)])
def test_warp(spark, t):
    image = np.random.default_rng(4).integers(0, 256, (5, 4, 3)).astype(float)
    df = spark.createDataFrame([(image.ravel().tolist(), tuple(map(float, t)))], f"p array<double>, {T}")
    got = df.select(P.warped(F.col("p"), 5, 4, F.col("t"), 6, 7)).first()[0]
    assert np.allclose(np.array(got).reshape(6, 7, 3), plain_warp(image, t, 6, 7), atol=1e-6)


def test_no_transform_and_one_that_moves_nothing(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], None), ([1.0, 2.0, 3.0, 4.0], (1.0, 0.0, 0.0, 0.0)), (None, (1.0, 0.0, 0.0, 0.0))], f"p array<double>, {T}")
    got = [r[0] for r in df.select(P.warped(F.col("p"), 2, 2, F.col("t"), 2, 2, 1)).collect()]
    assert got[:2] == [None, [1.0, 2.0, 3.0, 4.0]] and got[2] == [None] * 4


@pytest.mark.parametrize("model", [P.DETECTOR, P.RECOGNIZER, P.DETECTOR_BGR])
def test_padding_and_planes(spark, model):
    image = np.arange(2 * 3 * 3, dtype=float).reshape(2, 3, 3) * 7
    df = spark.createDataFrame([(image.ravel().tolist(),)], "p array<double>")
    got = df.select(P.padded(F.col("p"), 2, 3, 4).alias("p")).select("p", P.normalized(F.col("p"), 4, 4, model).alias("n")).first()
    square = np.pad(image, ((0, 2), (0, 1), (0, 0)))
    want = (square[:, :, list(model.channels)] - model.means) / model.divisors
    assert got.p == square.ravel().tolist() and np.allclose(got.n, want.transpose(2, 0, 1).ravel())


def test_an_image_must_fit_the_square(spark):
    with pytest.raises(ValueError):
        P.padded(F.col("p"), 5, 2, 4)
