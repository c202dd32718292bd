"""An inverted file of vectors: trained cells, vectors stored by cell, probes sent to their nearest cells.

Coarse centres are trained by Lloyd rounds on a bounded sample, each round one Spark aggregate. All vectors are stored by the
cell of their nearest centre, so a search reads the folders of the cells that its probes go to and no others (partition
pruning), in these the row groups of the cells, filters, and ranks what is left by exact cosine. With all cells probed the
search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from galleria.operators import topk as T
from galleria.operators.topk import HITS, PLACES, _ranked, as_hits, keep_best, matrix, rounds, unit

#: Centres are broadcast; so many of 512 dimensions take 64 MB.
MOST_CELLS = 1 << 14
#: Vectors of the sample for each centre, and Lloyd rounds.
SAMPLED, ROUNDS = 64, 5
#: Cells of a folder; its rows are in their order, so that row groups of other cells are skipped too.
CELLS_A_FOLDER = 16
#: Rows of a file, and most probes that are compared with a cell's vectors at once.
FILE_ROWS, BLOCK = 1 << 18, 1 << 13
#: Cosines that are worked on at once; so many stay in the cache, and memory doesn't grow with the number of cells.
AT_ONCE = 1 << 19
#: Queries that go in one round, like those of `topk`.
PROBES_AT_ONCE = T.PROBES_AT_ONCE


@dataclass(frozen=True)
class VectorIndex:
    """path: centres (cell, centre) and vectors (all columns of the gallery, by cell). sizes: vectors of each cell."""

    path: str
    centres: np.ndarray
    sizes: np.ndarray

    def vectors(self, spark: SparkSession, cells: np.ndarray | None = None) -> DataFrame:
        """The stored rows, of all cells or of some; the other cells' folders aren't read."""
        rows = spark.read.parquet(f"{self.path}/vectors")
        if cells is None or len(cells) == len(self.centres):
            return rows
        folders = sorted({int(c) // CELLS_A_FOLDER for c in cells})
        return rows.where(F.col("folder").isin(folders) & F.col("cell").isin([int(c) for c in cells]))

    def probed(self, vectors: np.ndarray, probes: int) -> Iterator[np.ndarray]:
        """Which cells are the nearest ones of each vector (rows of unit length), ties by number: a row a vector, in slices of
        whole eights."""
        for near in _near(vectors, self.centres, 8):
            if probes >= near.shape[1]:
                yield np.ones(near.shape, bool)
                continue
            last = np.partition(near, -probes, axis=1)[:, -probes, None]
            sure, ties = near > last, near == last
            yield sure | ties & (np.cumsum(ties, axis=1) <= probes - sure.sum(1, keepdims=True))


def _near(vectors: np.ndarray, centres: np.ndarray, multiple: int = 1) -> Iterator[np.ndarray]:
    """Cosines of vectors with all centres, in slices that bound memory."""
    step = max(multiple, AT_ONCE // len(centres) // multiple * multiple)
    for first in range(0, len(vectors), step):
        near = vectors[first : first + step] @ centres.T
        yield np.round(near, PLACES, out=near)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([near.argmax(1) for near in _near(vectors, centres)])


def default_cells(n: int) -> int:
    """Cells of a gallery of n vectors: a probe then compares with about as many centres as vectors."""
    return int(min(MOST_CELLS, max(1, 8 * round(n**0.5)), max(1, n)))


def _with_cells(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows (embedding and others) with the number of their nearest centre."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = _nearest(unit(matrix(batch.column("embedding"))), sent.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, rows.select("*", F.lit(0).alias("cell")).schema)


def train(gallery: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit length: the best of `rounds` Lloyd rounds over at most about SAMPLED vectors a cell.

    The sample is the part of the gallery whose hashed sample_id is lowest, so the same gallery gives the same sample. A
    centre without vectors stays where it is.
    """
    n = gallery.count()
    share = min(1.0, SAMPLED * cells / max(1, n))
    hashed = F.pmod(F.xxhash64("sample_id"), F.lit(1 << 20))
    sample = gallery.select("sample_id", "embedding").where(hashed < int(share * (1 << 20)) + 1)
    first = sample.groupBy("embedding").agg(F.min(F.xxhash64("sample_id")).alias("h"), F.min("sample_id").alias("id")).orderBy("h", "id").limit(cells)
    centres = unit([r["embedding"] for r in first.collect()])

    for _ in range(rounds):
        sent = gallery.sparkSession.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(sent.value), np.zeros(len(sent.value), np.int64)
            for batch in batches:
                if batch.num_rows:
                    v = unit(matrix(batch.column("embedding")))
                    cell = _nearest(v, sent.value)
                    np.add.at(total, cell, v)
                    count += np.bincount(cell, minlength=len(count))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64()))], ["cell", "total"])

        parts = sample.mapInArrow(sums, "cell int, total array<double>")
        moved = parts.groupBy("cell").agg(F.array(*[F.sum(F.col("total")[i]) for i in range(centres.shape[1])]).alias("total")).collect()
        after = centres.copy()
        for r in moved:
            after[r["cell"]] = r["total"]
        after = np.round(unit(after), 9)  # partial sums may come in any order
        if np.array_equal(after, centres):
            break
        centres = after
    return centres


def _store(rows: DataFrame, path: str, mode: str) -> None:
    """Write rows by cell; a large folder is written by several tasks, a small one by one."""
    rows = rows.withColumn("folder", F.floor(F.col("cell") / CELLS_A_FOLDER).cast("int"))
    sizes = rows.groupBy("folder").count().select("folder", F.ceil(F.col("count") / FILE_ROWS).alias("files"))
    split = rows.join(F.broadcast(sizes), "folder")  # at most MOST_CELLS rows
    dealt = split.withColumn("file", F.pmod(F.xxhash64("sample_id"), F.col("files"))).repartition("folder", "file").drop("files", "file")
    dealt.sortWithinPartitions("folder", "cell").write.mode(mode).partitionBy("folder").parquet(f"{path}/vectors")


def _sizes(spark: SparkSession, path: str, cells: int) -> np.ndarray:
    sizes = np.zeros(cells, np.int64)
    for r in spark.read.parquet(f"{path}/vectors").groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    return sizes


def build(gallery: DataFrame, path: str, cells: int | None = None, rounds: int = ROUNDS) -> VectorIndex:
    """Train the cells of a gallery and store its rows by cell in a new folder.

    gallery: sample_id, embedding (one dimension, no nulls) and any columns that filters ask for, none named cell or folder. Ids may
    repeat; copies of a vector stand in one cell. A gallery without rows can't be indexed.
    """
    spark = gallery.sparkSession
    n = gallery.count()
    if not n:
        raise ValueError("a gallery without vectors can't be indexed")
    centres = train(gallery, cells or default_cells(n), rounds)
    numbered = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(numbered, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    _store(_with_cells(gallery, centres), path, "errorifexists")
    return VectorIndex(path, centres, _sizes(spark, path, len(centres)))


def stored(spark: SparkSession, path: str) -> VectorIndex:
    """The index of a folder that `build` has written."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return VectorIndex(path, np.array([r["centre"] for r in rows]), _sizes(spark, path, len(rows)))


def add(index: VectorIndex, rows: DataFrame) -> VectorIndex:
    """The index with more rows; only the folders of their cells get new files, the centres stay."""
    _store(_with_cells(rows, index.centres), index.path, "append")
    return replace(index, sizes=_sizes(rows.sparkSession, index.path, len(index.centres)))


def _checked(k: int, probes: int) -> None:
    if not 1 <= k <= 20:
        raise ValueError("k must be between 1 and 20")
    if probes < 1:
        raise ValueError("at least one cell must be probed")


def search(index: VectorIndex, queries: DataFrame, k: int = 5, probes: int = 8, keep: Column | None = None) -> DataFrame:
    """query_id, sample_id, score, rank of the k best other vectors in the nearest cells of each query, like `topk`.

    queries: query_id, embedding. The filter keep is applied before the ranking; where it leaves fewer than k rows in the
    cells of a query, the query gets these. Queries are sent to the cells where they lie, in rounds of about PROBES_AT_ONCE,
    each of which reads its cells once; a task holds the best k of each query, and nothing else is shuffled.
    """
    _checked(k, probes)
    found = [_searched(index, queries.sparkSession, *asked, k, probes, keep) for asked in rounds(queries, queries.count(), PROBES_AT_ONCE)]
    if not found:
        return _ranked(queries.sparkSession.createDataFrame([], HITS), k)
    return _ranked(reduce(DataFrame.unionByName, found), k)


def _searched(index: VectorIndex, spark: SparkSession, ids: np.ndarray, m: np.ndarray, k: int, probes: int, keep: Column | None) -> DataFrame:
    """The k best of each query in each task; m are the queries' vectors."""
    # A row a cell: bits of the queries that go there.
    wanted = np.concatenate([np.packbits(part.T, axis=1) for part in index.probed(m, probes)], axis=1)
    kept = index.vectors(spark, np.flatnonzero(wanted.any(1)))
    kept = kept if keep is None else kept.where(keep)
    sent, block, everywhere = spark.sparkContext.broadcast((ids, m, wanted)), BLOCK, probes >= len(index.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m, wanted = sent.value
        best, owners = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            where, own = batch.column("cell").to_numpy(), batch.column("sample_id").to_numpy()
            vectors = unit(matrix(batch.column("embedding")))
            # Where all queries go to all cells, the vectors of a batch are one block.
            parts = [(np.ones(len(ids), bool), slice(None))] if everywhere else ((np.unpackbits(wanted[c], count=len(ids)).view(bool), np.flatnonzero(where == c)) for c in np.unique(where))
            for asking, here in parts:
                probing, there, names = np.flatnonzero(asking), vectors[here], own[here]
                step = max(1, min(block, AT_ONCE // len(names)))
                for first in range(0, len(probing), step):
                    part = probing[first : first + step]
                    scores = np.round(m[part] @ there.T, PLACES) + 0.0
                    scores[ids[part, None] == names[None, :]] = -np.inf
                    keep_best(best, owners, part, scores, names)
        yield as_hits(ids, best, owners)

    return kept.select("cell", "sample_id", "embedding").mapInArrow(run, HITS)


def scored_share(index: VectorIndex, queries: DataFrame, probes: int) -> float:
    """Which part of the stored vectors a search compares with a query, on average."""
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for cells in sent.value.probed(unit(matrix(batch.column("embedding"))), probes):
                    yield pa.RecordBatch.from_arrays([pa.array(cells @ sent.value.sizes)], ["n"])

    n = queries.select("embedding").mapInArrow(run, "n long").agg(F.avg("n")).first()[0] or 0.0
    return n / max(1, index.sizes.sum())

