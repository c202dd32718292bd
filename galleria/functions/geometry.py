"""Boxes, landmarks, anchors and decoding as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

#: Where the five landmarks of an aligned 112 x 112 face lie.
TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))
STRIDES, PER_CELL = (8, 16, 32), 2
#: Prior box sizes at each stride, and variances of their offsets.
MIN_SIZES, VARIANCES = {8: (16, 32), 16: (64, 128), 32: (256, 512)}, (0.1, 0.2)


def area(b: Column) -> Column:
    """Area of a box, no side below zero."""
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def iou(a: Column, b: Column, inclusive: bool = True) -> Column:
    """Intersection over union; inclusive coordinates add one to each side. 0 without a union."""
    one = 1.0 if inclusive else 0.0
    side = lambda low, high: F.greatest(F.lit(0.0), high - low + one)
    inter = side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * side(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"]))
    whole = lambda x: (x["x2"] - x["x1"] + one) * (x["y2"] - x["y1"] + one)
    union = whole(a) + whole(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def greedy_nms(ranked: Column, threshold: float) -> Column:
    """Boxes of an array (best first) that no kept box before them overlaps by more than the threshold."""
    empty = F.slice(ranked, 1, 0)
    return F.aggregate(ranked, empty, lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) > threshold), kept).otherwise(F.concat(kept, F.array(b))))


def one_shot_nms(ranked: Column, threshold: float) -> Column:
    """Boxes of an array (best first) that no box before them overlaps, be it kept or not."""
    return F.filter(ranked, lambda b, i: ~F.exists(F.slice(ranked, F.lit(1), i), lambda k: iou(k, b) > threshold))


def _anchor_grid(stride: int, n: int) -> Column:
    cells = F.sequence(F.lit(0), F.lit(n * n * PER_CELL - 1))
    place = lambda i: (F.floor(i / PER_CELL) % n * stride, F.floor(i / PER_CELL / n) * stride)
    return F.transform(cells, lambda i: F.struct(F.lit(stride).alias("stride"), place(i)[0].cast("double").alias("cx"), place(i)[1].cast("double").alias("cy")))


def anchors(size: int) -> Column:
    """Anchors of a detector's three grids, two in a cell, at its top left corner: stride, cx, cy in order."""
    return F.concat(*[_anchor_grid(stride, size // stride) for stride in STRIDES])


def decode_distances(cx: Column, cy: Column, stride: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Box from the distances of an anchor to its sides, in strides."""
    return F.struct((cx - left * stride).alias("x1"), (cy - top * stride).alias("y1"), (cx + right * stride).alias("x2"), (cy + bottom * stride).alias("y2"))


def decode_points(cx: Column, cy: Column, stride: Column, offsets: Column) -> Column:
    """Landmarks from their offsets to an anchor, in strides. offsets: array of [x, y]."""
    return F.transform(offsets, lambda p: F.array(cx + p[0] * stride, cy + p[1] * stride))


def _prior_grid(stride: int, sizes: tuple[int, ...], n: int, size: int) -> Column:
    cells = F.sequence(F.lit(0), F.lit(n * n * len(sizes) - 1))
    side = lambda i: F.element_at(F.array(*[F.lit(s / size) for s in sizes]), (i % len(sizes) + 1).cast("int"))
    cell = lambda i: F.floor(i / len(sizes))
    return F.transform(cells, lambda i: F.struct(((cell(i) % n + 0.5) * stride / size).alias("cx"), ((F.floor(cell(i) / n) + 0.5) * stride / size).alias("cy"), side(i).alias("w"), side(i).alias("h")))


def priors(size: int) -> Column:
    """Prior boxes, normalised, with centred cells: cx, cy, w, h in order."""
    return F.concat(*[_prior_grid(stride, sizes, -(-size // stride), size) for stride, sizes in MIN_SIZES.items()])


def decode_offsets(p: Column, dx: Column, dy: Column, dw: Column, dh: Column) -> Column:
    """Box (0 to 1) from a prior and its predicted offsets."""
    cx, cy = p["cx"] + dx * VARIANCES[0] * p["w"], p["cy"] + dy * VARIANCES[0] * p["h"]
    w, h = p["w"] * F.exp(dw * VARIANCES[1]), p["h"] * F.exp(dh * VARIANCES[1])
    clip = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return F.struct(clip(cx - w / 2).alias("x1"), clip(cy - h / 2).alias("y1"), clip(cx + w / 2).alias("x2"), clip(cy + h / 2).alias("y2"))


def decode_point_offsets(p: Column, offsets: Column) -> Column:
    """Landmarks from a prior and their predicted offsets; they may lie outside the image. offsets: array of [x, y]."""
    return F.transform(offsets, lambda o: F.array(p["cx"] + o[0] * VARIANCES[0] * p["w"], p["cy"] + o[1] * VARIANCES[0] * p["h"]))


def scale_clip(b: Column, sx: Column, sy: Column, width: Column, height: Column) -> Column:
    """A box in the units of the original image, inside it."""
    x = lambda v: F.least(width, F.greatest(F.lit(0.0), v * sx))
    y = lambda v: F.least(height, F.greatest(F.lit(0.0), v * sy))
    return F.struct(x(b["x1"]).alias("x1"), y(b["y1"]).alias("y1"), x(b["x2"]).alias("x2"), y(b["y2"]).alias("y2"))


def letterbox(width: Column, height: Column, size: int) -> Column:
    """Scale, resized sides and padding (right, bottom) that fit an image into a square."""
    scale = F.lit(float(size)) / F.greatest(width, height)
    w, h = F.rint(width * scale).cast("int"), F.rint(height * scale).cast("int")
    return F.struct(scale.alias("scale"), w.alias("width"), h.alias("height"), (F.lit(size) - w).alias("pad_right"), (F.lit(size) - h).alias("pad_bottom"))


def once(column: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a column that is found once a row, not wherever it is used: the element of an array of one."""
    return F.transform(F.array(column), use)[0]


def similarity_transform(landmarks: Column) -> Column:
    """Scale-and-rotation (a, b) and shift (tx, ty) that bring five landmarks closest to the template: x' = ax - by + tx,
    y' = bx + ay + ty. Null if they coincide or aren't finite.

    landmarks: array of five [x, y].
    """
    return once(landmarks, _fitted)


def _fitted(landmarks: Column) -> Column:
    total = lambda parts: reduce(lambda s, x: s + x, parts)
    xs, ys = ([landmarks[i][j] for i in range(5)] for j in (0, 1))
    mx, my = total(xs) / 5, total(ys) / 5
    ux, uy = sum(x for x, _ in TEMPLATE) / 5, sum(y for _, y in TEMPLATE) / 5
    spread = total([(x - mx) * (x - mx) + (y - my) * (y - my) for x, y in zip(xs, ys, strict=True)])
    a = total([(x - mx) * (u - ux) + (y - my) * (v - uy) for x, y, (u, v) in zip(xs, ys, TEMPLATE, strict=True)])
    b = total([(x - mx) * (v - uy) - (y - my) * (u - ux) for x, y, (u, v) in zip(xs, ys, TEMPLATE, strict=True)])
    means = F.struct(mx.alias("x"), my.alias("y"), spread.alias("spread"), a.alias("a"), b.alias("b"))
    return once(means, lambda m: _shifted(m, ux, uy))


def _shifted(m: Column, ux: float, uy: float) -> Column:
    ok = (m["spread"] > 0) & ~F.isnan(m["spread"]) & (m["spread"] < float("inf"))
    a, b = m["a"] / m["spread"], m["b"] / m["spread"]
    return F.when(ok, F.struct(a.alias("a"), b.alias("b"), (ux - a * m["x"] + b * m["y"]).alias("tx"), (uy - b * m["x"] - a * m["y"]).alias("ty")))
