"""Vector arithmetic over array columns, in double precision, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column, eps: float = 0.0) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(eps), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def finite(v: Column) -> Column:
    """Whether no element is null, NaN or infinite."""
    return ~F.exists(doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def l2_normalize(v: Column, eps: float = 0.0) -> Column:
    """The vector over its norm; without eps, zero and non-finite vectors give null."""
    n = norm(v, eps)
    return F.when(finite(v) & (n > 0), F.transform(doubles(v), lambda x: x / n))


def faults(v: Column, dim: int) -> Column:
    """Why a vector can't be stored: any of null, dimension, not finite, zero."""
    reasons = [
        F.when(v.isNull(), F.lit("null")),
        F.when(F.size(v) != dim, F.lit("dimension")),
        F.when(v.isNotNull() & ~finite(v), F.lit("not finite")),
        F.when(v.isNotNull() & finite(v) & (norm(v) == 0), F.lit("zero")),
    ]
    return F.array_compact(F.array(*reasons))
