"""Latency and throughput over event logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def percentiles(rows: DataFrame, by: list[str], value: str, points: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation (rank (n - 1) * p), and mean and population deviation.

    For groups of bounded size, such as the last rows of a key; `exact_percentiles` is for others.
    """
    return rows.groupBy(*by).agg(F.count(value).alias("n"), *[F.coalesce(F.percentile(value, F.lit(p)), F.lit(0.0)).alias(f"p{round(p * 100):02d}") for p in points], F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def _marked(df: DataFrame, by: list[str]) -> DataFrame:
    """The keys under other names, so that both sides of a join can be told apart."""
    return df.withColumnsRenamed({c: f"__{c}" for c in by})


def _same(by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.lit(True))


def exact_percentiles(rows: DataFrame, by: list[str], value: str, points: list[float], accuracy: int = 10_000) -> DataFrame:
    """The same columns as `percentiles` for groups of any size: no task holds a group's values.

    A sketch brackets each percentile to a few of 10,000 parts of its group (`accuracy`). One more pass counts the values in
    the brackets one by one and those between two brackets together, and all ranks are picked from these counts. The result
    is exact.
    """
    v, margin, points = F.col(value).cast("double"), 2 / accuracy, sorted(points)
    sketch = lambda side: F.percentile_approx(v, [min(1.0, max(0.0, p + side * margin)) for p in points], accuracy)
    groups = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), sketch(-1).alias("low"), sketch(1).alias("high"))
    known = rows.where(v.isNotNull()).select(*by, v.alias("v")).join(_marked(groups.select(*by, "n", "low", "high"), by), _same(by))
    inside = reduce(lambda a, b: a | b, [F.col("v").between(F.col("low")[i], F.col("high")[i]) for i in range(len(points))])
    passed = reduce(lambda a, b: a + b, [(F.col("v") > F.col("high")[i]).cast("int") for i in range(len(points))])
    # Values between two brackets are one row: their smallest and largest value are next to the brackets. They come before
    # the values of the bracket that they haven't passed.
    placed = known.select(*by, "n", "v", passed.alias("passed"), F.when(inside, F.col("v")).alias("x"))
    counts = placed.groupBy(*by, "n", "passed", "x").agg(F.count("*").alias("c"), F.min("v").alias("first"), F.max("v").alias("last"))
    ranked = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy("passed", F.col("x").asc_nulls_first())))
    start = F.col("upto") - F.col("c")
    at = lambda k: F.max(F.when((start <= k) & (k < F.col("upto")), F.when(k == start, F.col("first")).otherwise(F.col("last"))))
    name = lambda p: f"p{round(p * 100):02d}"
    rank = {p: (F.col("n") - 1) * p for p in points}
    ends = ranked.groupBy(*by, "n").agg(*[at(side(rank[p])).alias(f"{name(p)}{end}") for p in points for end, side in (("a", F.floor), ("b", F.ceil))])
    one = ends.select(*by, *[(F.col(f"{name(p)}a") + (F.col(f"{name(p)}b") - F.col(f"{name(p)}a")) * (rank[p] - F.floor(rank[p]))).alias(name(p)) for p in points])
    joined = groups.join(_marked(one, by), _same(by), "left")
    return joined.select(*by, "n", *[F.coalesce(name(p), F.lit(0.0)).alias(name(p)) for p in points], "mean", "std", "min", "max")


def last_n(rows: DataFrame, by: list[str], order: list[Column], n: int = 60) -> DataFrame:
    """The last n rows of each key. The window's limit is pushed below its shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def trailing_rate(rows: DataFrame, by: list[str], seconds: str, total: str, span: int = 60) -> DataFrame:
    """Adds rate: growth of a total that never falls over the rows of the last span seconds, by the time between them; 0 for one row."""
    w = Window.partitionBy(*by).orderBy(seconds).rangeBetween(-span, 0)
    grown = F.col(total) - F.min(total).over(w)
    passed = F.col(seconds) - F.min(seconds).over(w)
    return rows.withColumn("rate", F.coalesce(F.try_divide(grown.cast("double"), passed.cast("double")), F.lit(0.0)))


def row_rate(rows: DataFrame, by: list[str], order: list[Column], seconds: Column) -> DataFrame:
    """Adds gap: seconds since the row before of the same key; null for the first."""
    return rows.withColumn("gap", seconds - F.lag(seconds).over(Window.partitionBy(*by).orderBy(*order)))


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key as an aggregate: no sort, and partial results before the shuffle."""
    others = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(*by, "r.*")


def transitions(rows: DataFrame, by: list[str], order: list[Column], state: str) -> DataFrame:
    """How often each state follows each other one."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("before", before).where("before IS NOT NULL").groupBy("before", F.col(state).alias("after")).agg(F.count("*").alias("n"))
