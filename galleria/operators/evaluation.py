"""Verification statistics: pair scores, distributions, operating curves.

All pairs of a person's samples are scored in blocks: a block of samples meets another one in a task, which multiplies them and
sends on what is asked for, the pairs themselves or counts of them. Scores are whole millionths, so all sums of them are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from galleria.functions.vectors import cosine
from galleria.operators.metrics import exact_percentiles

#: Gives the same rows back, from a written table perhaps, so that they are worked out once.
Stage = Callable[[DataFrame], DataFrame]

PLACES, MILLION = 6, 1_000_000
#: Samples of a block, and pairs that a task works on at once.
BLOCK, AT_ONCE = 4096, 1 << 18
#: Millionths of a bin in which scores are counted first; the bin of scores that are no numbers, beyond all others.
WIDTH, NO_NUMBER = 1000, 1 << 20

#: ids of both sides, scores in millionths (NaN where a vector isn't finite), which pairs have none (a vector is zero or null, or
#: their dimensions differ; None if all have one), which places are pairs (None if all are), and whether both sides are one block.
Scored = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None, bool]


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The vectors in double precision, filled up with zeros; their norms, their dimensions, and which have no cosine with any."""
    sizes = np.array(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    m = np.zeros((len(sizes), int(sizes.max(initial=0))))
    m[np.arange(m.shape[1]) < sizes[:, None]] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    norms = np.sqrt(np.cumsum(m * m, axis=1)[:, -1]) if m.shape[1] else np.zeros(len(m))
    missing = norms == 0
    if flat.null_count:
        missing[np.repeat(np.arange(len(sizes)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    return m, norms, sizes, missing


def _millionths(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Cosines in millionths, halves away from zero. Those next to a half are summed up in the order of the elements, as SQL does."""
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        exact = x @ y.T / (nx[:, None] * ny) * MILLION
        whole = np.rint(exact)
        for k in range(0, len(near := np.flatnonzero(np.abs(np.abs(exact - whole) - 0.5) < 1e-5)), 4096):
            i, j = np.divmod(near[k : k + 4096], len(y))
            plain = np.cumsum(x[i] * y[j], axis=1)[:, -1] / (nx[i] * ny[j]) * MILLION
            whole[i, j] = np.copysign(np.floor(np.abs(plain) + 0.5), plain)
    return whole + 0.0


def _scored(i: int, j: int, table: pa.Table) -> Iterator[Scored]:
    """Slices of the pairs of blocks i and j of a person, i <= j. table: sample_id, embedding, place (a sample's block)."""
    place, ids = table.column("place").to_numpy(), table.column("sample_id").to_numpy()
    m, norms, sizes, odd = _matrix(table.column("embedding").combine_chunks())
    mixed = sizes.min() != sizes.max()
    x, y = np.flatnonzero(place == i), np.flatnonzero(place == j)
    for first in range(0, len(x) if len(y) else 0, step := max(1, AT_ONCE // max(1, len(y)))):
        part = x[first : first + step]
        none = odd[part, None] | odd[y] if odd.any() else None
        if mixed:
            none = (sizes[part, None] != sizes[y]) | (False if none is None else none)
        pairs = ids[part, None] < ids[y] if i == j else None
        yield ids[part], ids[y], _millionths(m[part], norms[part], m[y], norms[y]), none, pairs, i == j


def _in_blocks(samples: DataFrame, work: Callable[[list[pa.Scalar], Iterator[Scored]], Iterator[pa.RecordBatch]], schema: T.StructType, with_columns: list[str] | None = None) -> DataFrame:
    """What work makes of the pairs of two blocks of a person's samples, for all of these; persons of one sample have none.

    A person's samples are dealt by a hash of their id into blocks of about BLOCK; each is sent to the tasks of its block with
    each other one, so a task holds two blocks, whatever the person's size. work gets the person, the first values of further
    columns (equal for all samples of a person) and the scores in slices.
    """
    more = with_columns or []
    known = samples.where("sample_id IS NOT NULL").select("sample_id", "person_id", "embedding", *more)
    sizes = known.groupBy("person_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = known.join(sizes, "person_id").withColumns({"place": F.pmod(F.xxhash64("sample_id"), F.col("blocks")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    sent = dealt.select("person_id", F.least("place", "other").alias("i"), F.greatest("place", "other").alias("j"), "place", "sample_id", "embedding", *more)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        yield from work([key[0], *[table.column(c)[0] for c in more]], _scored(key[1].as_py(), key[2].as_py(), table))

    # Little is sent and much is computed: tasks are many, and Spark doesn't join them by their bytes.
    tasks = 8 * samples.sparkSession.sparkContext.defaultParallelism
    return sent.repartition(tasks, "person_id", "i", "j").groupBy("person_id", "i", "j").applyInArrow(run, schema)


def _kind(samples: DataFrame, column: str, name: str) -> T.StructField:
    return T.StructField(name, samples.schema[column].dataType)


def genuine_pairs(samples: DataFrame) -> DataFrame:
    """Scores of all pairs of samples of the same person: a, b (a < b), person_id, score.

    samples: sample_id, person_id, embedding. The pairs of a person are the result asked for; persons of one sample have
    none. They leave a task in slices.
    """

    def work(person: list[pa.Scalar], slices: Iterator[Scored]) -> Iterator[pa.RecordBatch]:
        for x, y, whole, none, pairs, _ in slices:
            i, j = np.nonzero(np.ones(whole.shape, bool) if pairs is None else pairs)
            first = x[i] < y[j]
            score = pa.array(whole[i, j] / MILLION, mask=None if none is None else none[i, j])
            columns = [pa.array(np.where(first, x[i], y[j])), pa.array(np.where(first, y[j], x[i])), pa.repeat(person[0], len(i)), score]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "person_id", "score"])

    schema = T.StructType([_kind(samples, "sample_id", "a"), _kind(samples, "sample_id", "b"), _kind(samples, "person_id", "person_id"), T.StructField("score", T.DoubleType())])
    return _in_blocks(samples, work, schema)


def genuine_by_sample(samples: DataFrame) -> DataFrame:
    """How each sample scores against the others of its person: sample_id, n, and the low, total and high of its scores in millionths.

    Pairs whose score is missing or no number count in n only.
    """

    def work(_: list[pa.Scalar], slices: Iterator[Scored]) -> Iterator[pa.RecordBatch]:
        def sides(whole: np.ndarray, pair: np.ndarray | None, real: np.ndarray | None, axis: int) -> np.ndarray:
            n = np.full(whole.shape[1 - axis], whole.shape[axis]) if pair is None else pair.sum(axis)
            if real is None:
                return np.array([n, whole.min(axis), whole.sum(axis), whole.max(axis)])
            return np.array([n, np.where(real, whole, np.inf).min(axis), np.where(real, whole, 0).sum(axis), np.where(real, whole, -np.inf).max(axis)])

        found, far, ids = [], None, []
        for x, y, whole, none, _pairs, same in slices:
            pair = x[:, None] != y if same else None
            lost = np.isnan(whole) if none is None else none | np.isnan(whole)
            real = (~lost if pair is None else pair & ~lost) if same or lost.any() else None
            ids.append(x)
            found.append(sides(whole, pair, real, 1))
            # The square of a block with itself has both ends of a pair as rows.
            if not same:
                part = sides(whole, pair, real, 0)
                far = part if far is None else np.array([far[0] + part[0], np.minimum(far[1], part[1]), far[2] + part[2], np.maximum(far[3], part[3])])
                last = y
        if far is not None:
            ids.append(last)
            found.append(far)
        if found:
            (n, low, total, high), ids = np.concatenate(found, axis=1), np.concatenate(ids)
            nothing = np.isinf(low)
            values = [pa.array(np.where(nothing, 0, v).astype(np.int64), mask=nothing) for v in (low, total, high)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), *values], ["sample_id", "n", "low", "total", "high"]).filter(pa.array(n > 0))

    schema = T.StructType([_kind(samples, "sample_id", "sample_id"), *[T.StructField(c, T.LongType()) for c in ("n", "low", "total", "high")]])
    parts = _in_blocks(samples, work, schema)
    return parts.groupBy("sample_id").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("total").alias("total"), F.max("high").alias("high"))


def _every(whole: np.ndarray, none: np.ndarray | None, pairs: np.ndarray | None) -> tuple[np.ndarray, int, int]:
    """The scores of a slice that are numbers, and how many pairs have no score or no number."""
    found = whole.ravel() if pairs is None else whole[pairs]
    missing = 0
    if none is not None:
        lost = none.ravel() if pairs is None else none[pairs]
        missing, found = int(lost.sum()), found[~lost]
    real = found[~np.isnan(found)]
    return real, missing, len(found) - len(real)


def genuine_bins(samples: DataFrame) -> DataFrame:
    """The scores of all genuine pairs, counted: person_id, bin (WIDTH millionths; null without a score), n, total, squares.

    total and squares are sums of what the scores are above the start of their bin.
    """

    def work(person: list[pa.Scalar], slices: Iterator[Scored]) -> Iterator[pa.RecordBatch]:
        bins = 2 * MILLION // WIDTH + 1
        sums, missing, no_number = np.zeros((3, bins), np.int64), 0, 0
        for _x, _y, whole, none, pairs, _same in slices:
            real, lost, odd = _every(whole, none, pairs)
            missing, no_number = missing + lost, no_number + odd
            at, above = np.divmod(real.astype(np.int64) + MILLION, WIDTH)
            sums += np.array([np.bincount(at, w, bins) for w in (None, above, above * above)]).astype(np.int64)
        used = np.flatnonzero(sums[0])
        bin, rows = (used - MILLION // WIDTH).tolist(), sums[:, used].tolist()
        for b, n in ((None, missing), (NO_NUMBER, no_number)):
            if n:
                bin, rows = [*bin, b], [[*r, v] for r, v in zip(rows, (n, 0, 0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.repeat(person[0], len(bin)), pa.array(bin, pa.int32()), *[pa.array(r, pa.int64()) for r in rows]], ["person_id", "bin", "n", "total", "squares"])

    schema = T.StructType([_kind(samples, "person_id", "person_id"), T.StructField("bin", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("n", "total", "squares")]])
    parts = _in_blocks(samples, work, schema)
    return parts.groupBy("person_id", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])


def _genuine_values(samples: DataFrame) -> DataFrame:
    """Counts of the single scores in some bins of each person (bins: an array, equal for all its samples): person_id, s, n."""

    def work(person: list[pa.Scalar], slices: Iterator[Scored]) -> Iterator[pa.RecordBatch]:
        bins = np.array(sorted(b for b in person[1].as_py() if b != NO_NUMBER), np.int64)
        slot, size, no_number = np.full(2 * MILLION // WIDTH + 1, -1), len(bins) * WIDTH, 0
        slot[bins + MILLION // WIDTH] = np.arange(len(bins))
        count = np.zeros(size, np.int64)
        for _x, _y, whole, none, pairs, _same in slices:
            real, _, odd = _every(whole, none, pairs)
            at, above = np.divmod(real.astype(np.int64) + MILLION, WIDTH)
            inside = slot[at] >= 0
            count += np.bincount(slot[at[inside]] * WIDTH + above[inside], minlength=size)
            no_number += odd
        used = np.flatnonzero(count)
        s, n = bins[used // WIDTH] * WIDTH + used % WIDTH, count[used]
        if no_number:
            s, n = np.append(s.astype(np.float64), np.nan), np.append(n, no_number)
        yield pa.RecordBatch.from_arrays([pa.repeat(person[0], len(s)), pa.array(s, pa.float64(), from_pandas=False), pa.array(n, pa.int64())], ["person_id", "s", "n"])

    schema = T.StructType([_kind(samples, "person_id", "person_id"), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    parts = _in_blocks(samples, work, schema, ["bins"])
    return parts.groupBy("person_id", "s").agg(F.sum("n").alias("n"))


POINTS = (5, 25, 50, 75, 95, 99)


def describe_genuine(samples: DataFrame, stage: Stage = lambda rows: rows) -> DataFrame:
    """`describe` of the genuine scores of each person, in millionths: person_id, n, mean, std, min, max and exact percentiles.

    The scores are counted in bins; the bins that hold a percentile or an extreme are then counted value by value, so no task
    holds a person's scores. stage writes the bins, which are asked three times.
    """
    bins = stage(genuine_bins(samples))
    b, exact = (F.col("bin") * WIDTH).cast("decimal(18,0)"), lambda c: F.col(c).cast("decimal(18,0)")
    number = F.when(F.col("bin") != NO_NUMBER, b)
    sums = bins.groupBy("person_id").agg(
        F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))), F.lit(0)).alias("n"),
        F.sum(exact("n") * number + exact("total")).alias("sum"),
        F.sum(exact("n") * (number * number).cast("decimal(18,0)") + exact("total") * number * 2 + exact("squares")).alias("squares"),
        F.max(F.col("bin") == NO_NUMBER).alias("odd"),
    )
    n = F.col("n").cast("decimal(18,0)")
    spread = F.sqrt((n * F.col("squares") - F.col("sum") * F.col("sum")).cast("double")) / F.col("n")
    real = lambda c: F.when(F.col("odd"), F.lit(float("nan"))).otherwise(c)
    whole = sums.select("person_id", "n", real(F.try_divide(F.col("sum").cast("double"), F.col("n").cast("double"))).alias("mean"), real(F.when(F.col("n") > 0, spread)).alias("std"))
    points = {"min": 0.0, **{f"p{p}": p / 100 for p in POINTS}, "max": 1.0}
    ranks = {(name, end): side((F.col("all") - 1) * p) for name, p in points.items() for end, side in (("a", F.floor), ("b", F.ceil))}
    ordered = Window.partitionBy("person_id").orderBy("s")
    placed = lambda rows: rows.withColumns({"upto": F.sum("n").over(ordered), "all": F.sum("n").over(Window.partitionBy("person_id"))})
    has = lambda rank: (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
    asked = F.lit(False)
    for rank in ranks.values():
        asked = asked | has(rank)
    coarse = placed(bins.where("bin IS NOT NULL").select("person_id", "bin", (F.col("bin") * F.lit(WIDTH).cast("double")).alias("s"), "n")).withColumn("asked", asked)
    values = _genuine_values(samples.join(coarse.where("asked").groupBy("person_id").agg(F.collect_list("bin").alias("bins")), "person_id"))
    fine = placed(coarse.where("NOT asked").select("person_id", "s", "n").unionByName(values))
    at = fine.groupBy("person_id", "all").agg(*[F.max(F.when(has(rank), F.col("s"))).alias(f"{name}_{end}") for (name, end), rank in ranks.items()])
    part = lambda p: (F.col("all") - 1) * p - F.floor((F.col("all") - 1) * p)
    found = at.select("person_id", *[(F.col(f"{m}_a") + (F.col(f"{m}_b") - F.col(f"{m}_a")) * part(p)).alias(m) for m, p in points.items()])
    rows = whole.join(found, "person_id", "left")
    return rows.select("person_id", "n", "mean", "std", "min", "max", *[F.coalesce(f"p{p}", F.lit(0.0)).alias(f"p{p}") for p in POINTS])


def impostor_pairs(samples: DataFrame, per_sample: int = 4, buckets: int | None = None) -> DataFrame:
    """Scores of a fixed sample of pairs of different persons: a, b, score.

    Samples are dealt by a hash of their id into as many buckets as give about 2 * per_sample of them each, and are paired
    inside their bucket, so about per_sample pairs a sample are drawn: their number grows with the samples only. The
    number of buckets comes from a count of the samples; every run draws the same pairs.
    """
    n = buckets or max(1, samples.count() // (2 * per_sample))
    bucket = F.conv(F.substring(F.md5(F.col("sample_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % n
    x = samples.select(F.col("sample_id").alias("a"), F.col("person_id").alias("p"), F.col("embedding").alias("u"), bucket.alias("k"))
    y = samples.select(F.col("sample_id").alias("b"), F.col("person_id").alias("q"), F.col("embedding").alias("v"), bucket.alias("k"))
    return x.join(y, "k").where("a < b AND p <> q").select("a", "b", F.round(cosine(F.col("u"), F.col("v")), PLACES).alias("score"))


def negative_at(pairs: DataFrame, share: float = 0.05) -> DataFrame:
    """For each sample how many impostor scores it has, the largest, and the one at place int(share * n) from the top.

    pairs: a, b, score; both ends count. Ties don't matter, as only scores are returned.
    """
    both = pairs.select(F.explode(F.array("a", "b")).alias("sample_id"), "score")
    mine = Window.partitionBy("sample_id")
    ranked = both.withColumns({"place": F.row_number().over(mine.orderBy(F.desc("score"))), "n": F.count("*").over(mine)})
    return ranked.groupBy("sample_id").agg(F.max("n").alias("n"), F.max("score").alias("largest"), F.max(F.when(F.col("place") == F.floor(F.col("n") * share) + 1, F.col("score"))).alias("at_share"))


def drawn(samples: DataFrame, n: int = 100) -> DataFrame:
    """n samples in an order that looks random and is the same in every run: by a hash of the id, then the id."""
    return samples.orderBy(F.md5(F.col("sample_id").cast("string").cast("binary")), "sample_id").limit(n)


def describe(rows: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Count, mean, population deviation, extremes and exact percentiles."""
    found = exact_percentiles(rows, by or [], score, [p / 100 for p in POINTS])
    return found.select(*(by or []), "n", "mean", "std", "min", "max", *[F.col(f"p{p:02d}").alias(f"p{p}") for p in POINTS])


def _step(hundredth: Column, low: int, high: int) -> Column:
    """The first threshold above a score, of which the last hundredth below is given; `low` without a score."""
    return F.least(F.lit(high + 1), F.greatest(F.lit(low), hundredth.cast("int") + 1))


def steps(pairs: DataFrame, low: int, high: int) -> DataFrame:
    """How many pairs fall between thresholds: step, g (genuine), i (impostors); pairs: genuine (boolean), score."""
    return pairs.groupBy(_step(F.floor(F.round(F.col("score") * 100, 4)), low, high).alias("step")).agg(F.count_if("genuine").alias("g"), F.count_if(~F.col("genuine")).alias("i"))


def genuine_steps(samples: DataFrame, low: int, high: int) -> DataFrame:
    """`steps` of all genuine pairs, which are counted where they are scored."""
    step = _step(F.floor(F.col("bin") / (MILLION // 100 // WIDTH)), low, high)
    return genuine_bins(samples).groupBy(step.alias("step")).agg(F.sum("n").alias("g"), F.lit(0).cast("long").alias("i"))


def curve(pairs: DataFrame, low: int = 30, high: int = 74) -> DataFrame:
    """tp, fn, fp, tn and rates at thresholds low/100 to high/100; pairs: genuine (boolean), score."""
    return curve_of(steps(pairs, low, high), low, high)


def curve_of(steps: DataFrame, low: int, high: int) -> DataFrame:
    """The curve of `steps`, of which some may come several times: their counts (one row a step) are summed up."""
    grid = steps.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("t"))
    # A pair of step s passes every threshold below s.
    rows = grid.join(F.broadcast(steps)).groupBy("t").agg(
        F.coalesce(F.sum(F.when(F.col("step") > F.col("t"), F.col("g"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("step") <= F.col("t"), F.col("g"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(F.col("step") > F.col("t"), F.col("i"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(F.col("step") <= F.col("t"), F.col("i"))), F.lit(0)).alias("tn"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")), F.lit(0.0))
    return rows.select((F.col("t") / 100.0).cast("double").alias("threshold"), "tp", "fn", "fp", "tn", share("tp", "fn").alias("tar"), share("fp", "tn").alias("far"), share("fn", "tp").alias("frr"))


def equal_error(rows: DataFrame) -> DataFrame:
    """The threshold at which both error rates are closest, the first on ties."""
    best = F.min_by(F.struct("threshold", "far", "frr"), F.struct(F.abs(F.col("far") - F.col("frr")), F.col("threshold")))
    return rows.agg(best.alias("r")).select("r.*")


def constrained(rows: DataFrame, limit: Column, best: Column, name: str) -> DataFrame:
    """The threshold with the largest `best` among the rows that keep a limit, the first on ties."""
    return rows.where(limit).agg(F.max_by(F.struct("threshold", "tar", "far", "frr"), F.struct(best, -F.col("threshold"))).alias("r")).select(F.lit(name).alias("rule"), "r.*")
