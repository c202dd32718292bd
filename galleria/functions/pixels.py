"""Pixels as array columns: padding, affine warps and normalised planes, as expressions.

An image is an array of its values, row by row, the channels of a pixel side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from galleria.functions.geometry import once


@dataclass(frozen=True)
class Input:
    """What a model expects: for each plane the channel it is taken from, its mean and its divisor."""

    channels: tuple[int, ...]
    means: tuple[float, ...]
    divisors: tuple[float, ...]


#: Inputs of a detector and a recogniser in RGB, and of a detector in BGR.
DETECTOR = Input((0, 1, 2), (127.5,) * 3, (128.0,) * 3)
RECOGNIZER = Input((0, 1, 2), (127.5,) * 3, (127.5,) * 3)
DETECTOR_BGR = Input((2, 1, 0), (104.0, 117.0, 123.0), (1.0,) * 3)


def _each(n: int, value) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value)


def _div(i: Column, n: int) -> Column:
    return F.floor(i / n).cast("int")


def padded(pixels: Column, height: int, width: int, size: int, channels: int = 3) -> Column:
    """An image in the top left corner of a black square."""
    if max(height, width) > size:
        raise ValueError("the image is larger than the square")

    def value(own: Column, i: Column) -> Column:
        y, x = _div(i, size * channels), _div(i, channels) % size
        return F.when((y < height) & (x < width), own[(y * width + x) * channels + i % channels]).otherwise(F.lit(0.0))

    return once(pixels, lambda own: _each(size * size * channels, lambda i: value(own, i)))


def normalized(pixels: Column, height: int, width: int, model: Input, channels: int = 3) -> Column:
    """The planes of a model's input, one after the other: each value less its plane's mean, divided."""
    area = height * width
    plane = lambda own, n: _each(area, lambda i: (own[i * channels + model.channels[n]] - model.means[n]) / model.divisors[n])
    return once(pixels, lambda own: F.concat(*[plane(own, n) for n in range(len(model.channels))]))


def warped(pixels: Column, height: int, width: int, transform: Column, out_height: int, out_width: int, channels: int = 3) -> Column:
    """An image under x' = ax - by + tx, y' = bx + ay + ty; null without a transform.

    Each pixel that comes out is looked up where it came from, between the four pixels around that place; what lies
    outside of the image is 0. A transform that maps all to a point takes the first pixel everywhere.

    transform: struct of a, b, tx, ty, as `similarity_transform` gives it.
    """

    def at(own: Column, y: Column, x: Column, c: Column) -> Column:
        inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
        return F.when(inside, own[((y * width + x) * channels + c).cast("int")]).otherwise(F.lit(0.0))

    def place(t: Column, i: Column) -> Column:
        a, b, square = t["a"], t["b"], t["a"] * t["a"] + t["b"] * t["b"]
        dy, dx = _div(i, out_width * channels) - t["ty"], _div(i, channels) % out_width - t["tx"]
        x = F.when(square > 0, (a * dx + b * dy) / square).otherwise(F.lit(0.0))
        y = F.when(square > 0, (a * dy - b * dx) / square).otherwise(F.lit(0.0))
        return F.struct(x.alias("x"), y.alias("y"), (i % channels).alias("c"))

    def between(own: Column, p: Column) -> Column:
        left, top = _whole(p["x"]), _whole(p["y"])
        right, down = p["x"] - left, p["y"] - top
        upper = (1 - right) * at(own, top, left, p["c"]) + right * at(own, top, left + 1, p["c"])
        lower = (1 - right) * at(own, top + 1, left, p["c"]) + right * at(own, top + 1, left + 1, p["c"])
        return (1 - down) * upper + down * lower

    places = once(transform, lambda t: _each(out_height * out_width * channels, lambda i: place(t, i)))
    return F.when(transform.isNotNull(), once(pixels, lambda own: F.transform(places, lambda p: between(own, p))))


def _whole(v: Column) -> Column:
    """The next lower whole number as a double: places may lie far outside of what an int holds."""
    return v - F.pmod(v, F.lit(1.0))
