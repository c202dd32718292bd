"""Document fingerprints: digests of content-defined chunks, weighted by chunk length, measure containment."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from galleria.llm.chunks import Sizes, boundaries, code_points
from galleria.llm.common import bound_batches, shuffle_parts, slices

#: Chunk sizes in code points. A length fits one byte of the fingerprint.
SIZES = Sizes(8, 32, 96)
#: Bytes of a chunk in the fingerprint: a digest of five and a length of one.
DIGEST_BYTES = 5


def chunk_set(text: str) -> dict[int, int]:
    """Distinct chunks of a text: digest -> length in code points."""
    points = code_points(text)
    raw, found, start = points.tobytes(), {}, 0
    for end in boundaries(points, SIZES):
        found[xxhash.xxh64_intdigest(raw[4 * start : 4 * end]) >> 24] = end - start
        start = end
    return found


def fingerprint(chunks: dict[int, int]) -> str:
    """A text form of the set: six bytes a chunk, by ascending digest, in base 64."""
    packed = np.fromiter((d << 8 | n for d, n in chunks.items()), np.uint64, len(chunks))
    packed.sort()
    return base64.b64encode(packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def parse(text: str) -> dict[int, int]:
    """The set that a fingerprint stands for."""
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, DIGEST_BYTES + 1)
    return {int.from_bytes(bytes(x[:DIGEST_BYTES]), "big"): int(x[DIGEST_BYTES]) for x in raw}


def containment(own: dict[int, int], other: dict[int, int]) -> float:
    """Share of the own chunks' length that the other has too; two empty sets contain each other."""
    if not own:
        return 0.0 if other else 1.0
    return sum(own[d] for d in own.keys() & other.keys()) / sum(own.values())


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt out so that each bucket holds a range of doc_ids in order and ends with the first row of the next one.

    Adds bucket and tail (true: the row only closes the bucket). The bounds of the ranges are doc_ids of the table, as
    many as partitions are asked for; the texts are shuffled once.
    """
    spark = docs.sparkSession
    n = 4 * shuffle_parts(spark)
    bounds = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)})
    least = docs.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    bounds = [b for b in bounds if b > least[0]]

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, np.int64), ids.fillna(-(1 << 63)).to_numpy(np.int64), side="right"))

    last = len(bounds)
    opens = F.col("doc_id").isNull() if least[1] else F.col("doc_id") == F.lit(least[0])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("bucket", bucket_of("doc_id"))
    closes = F.when(opens, F.lit(last)).when(F.col("doc_id").isin(bounds) if bounds else F.lit(False), F.col("bucket") - 1)
    placed = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail")), F.struct(closes.alias("bucket"), F.lit(True).alias("tail")))
    dealt = rows.select("doc_id", "text", F.explode(placed).alias("p")).where("p.bucket IS NOT NULL").select("doc_id", "text", "p.*")
    return dealt.repartition(shuffle_parts(spark), "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness. Returns RESULT.

    docs: doc_id, text, further columns are left out. The next document is the one that follows by doc_id, null doc_ids
    first and ties by text; the last is followed by the first, a sole document by itself. near_edited and near_next are
    the share of the own chunks, by length, that the edited text and the next document hold: 1 if both are empty, 0 if
    only the own text is. Null texts count as empty; repeated rows are documents of their own; no rows give no rows.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row that waits for its next one: bucket, doc_id, text, chunks
        closed = -1
        for batch in slices(batches):
            out = []
            for doc_id, text, bucket, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "tail")), strict=True):
                if bucket == closed:  # more rows with the doc_id of the closing one
                    continue
                chunks = chunk_set(text)
                if before is not None:
                    out.append(compared(*before, text, chunks))
                before = None if tail else (doc_id, text, chunks)
                if tail:
                    closed = bucket
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)

    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], RESULT)
    return with_next(docs).mapInArrow(run, RESULT)


NAMES = [c.split()[0] for c in RESULT.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def compared(doc_id: int | None, text: str, chunks: dict[int, int], following: str, following_chunks: dict[int, int]) -> tuple:
    changed = edited(text, following)
    changed_chunks = chunk_set(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprint(chunks), fingerprint(changed_chunks), containment(chunks, changed_chunks), containment(chunks, following_chunks)
