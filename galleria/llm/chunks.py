"""Content-defined chunks: a gear rolling hash over code points with normalised boundaries.

The hash of a place sums random values of the last 32 characters, each shifted by its distance, so boundaries depend on
content only and come back after an insertion. Below the normal size a boundary needs two more zero bits than above it,
which draws the sizes together.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np

#: Shifts of the doubling steps: after them each value sums 32 characters.
STEPS = (1, 2, 4, 8, 16)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each integer (the finaliser of a split-mix generator)."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


GEAR = (scrambled(np.arange(1 << 16)) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Sizes:
    """Chunk sizes in code points: least, normal (a power of two) and most."""

    least: int
    normal: int
    most: int


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gear_hash(points: np.ndarray) -> np.ndarray:
    """The rolling hash that ends at each code point."""
    h = GEAR[points] if not len(points) or points.max() < 1 << 16 else (scrambled(points) >> np.uint64(32)).astype(np.uint32)
    for step in STEPS:
        if len(h) <= step:
            break
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    return h


def boundaries(points: np.ndarray, sizes: Sizes) -> list[int]:
    """Ends of the chunks of a text, the last is its length; none for the empty text."""
    n = len(points)
    if n <= sizes.least:
        return [n] if n else []
    bits = sizes.normal.bit_length() - 1
    h = gear_hash(points)
    loose_at = np.flatnonzero(h < np.uint32(1 << (32 - bits + 1)))
    strict = (loose_at[h[loose_at] < np.uint32(1 << (32 - bits - 1))] + 1).tolist()
    loose = (loose_at + 1).tolist()
    ends, at = [], 0
    while n - at > sizes.least:
        k = bisect_left(strict, at + sizes.least)
        if k < len(strict) and strict[k] < at + sizes.normal:
            at = strict[k]
        else:
            k = bisect_left(loose, at + sizes.normal)
            at = min(loose[k] if k < len(loose) else n, at + sizes.most, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends
