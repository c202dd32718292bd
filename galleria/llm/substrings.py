"""Substring dedup: content-defined chunks are deduplicated by digest.

Gear-hash boundaries depend on content only, so a passage that stands in two documents is cut alike in both, whatever
stands before it. Chunks of one digest are one text; all but the first are dropped. Documents of equal text are known by
the hash of their text: their chunks need no comparison, and their passages count as repeated as a whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window, functions as F

from galleria.llm.chunks import Sizes, boundaries, code_points
from galleria.llm.common import cut_lineage, map_batches, quoted, removed, small, stored, texts_of

#: Chunk sizes in code points.
SIZES = Sizes(16, 32, 96)
#: Words of the shortest passage that counts. Its first and last chunks also hold characters from outside it; a run of
#: neighbouring repeated chunks is a candidate from RUN_WORDS words on: a chunk of the least size has as many of two letters.
LEAST_WORDS, RUN_WORDS = 50, 5
#: A chunk's place in one integer: its number, where it starts (code points) and how many words it has (255 at most).
NUMBER, START, WORDS = 1 << 40, 1 << 8, 255
WORD = re.compile(r"\S+")

CHUNKS = "doc_id long, h long, n_words long, digests array<long>, places array<long>"


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n_words, and digests and places of the chunks."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, places = [], [], []
        for text in texts_of(batch):
            points = code_points(text)
            ends, data = boundaries(points, SIZES), points.tobytes()
            spans = list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []
            digests.append([xxhash.xxh3_64_intdigest(data[4 * a : 4 * b]) - (1 << 63) for a, b in spans])
            places.append([i * NUMBER + a * START + min(WORDS, len(text[a:b].split())) for i, (a, b) in enumerate(spans)])
            sizes.append(len(text.split()))
        arrays = [batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(digests, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "h", "n_words", "digests", "places"])

    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), rows, CHUNKS)


def narrowed(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of df whose key stands in keys. Keys grow with the corpus, so both sides are shuffled at every size; the result
    is checkpointed, so that no later aggregate reuses its distribution and Spark can split the rows of a frequent key."""
    return cut_lineage(df.join(keys, on, "left_semi"))


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """h, digest, place of the chunks whose digest stands in texts that differ. chunks: written before."""
    rows = chunks.select("h", F.explode(F.arrays_zip("digests", "places")).alias("c")).select("h", F.col("c.digests").alias("digest"), F.col("c.places").alias("place"))
    shared = cut_lineage(rows.groupBy("digest").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("digest"))
    return narrowed(rows, shared, "digest").distinct()


def runs(found: DataFrame) -> DataFrame:
    """The chunks with run_words: the words of the run of neighbouring repeated chunks that each one is in."""
    number = F.floor(F.col("place") / NUMBER)
    ranked = found.withColumn("run", number - F.row_number().over(Window.partitionBy("h").orderBy("place")))
    return ranked.withColumn("run_words", F.sum(F.col("place") % START).over(Window.partitionBy("h", "run")))


def hashed(data: bytes, ends: list[int], size: int, firsts: range) -> np.ndarray:
    """Hashes of the windows of size words that start at these words; data: words joined by spaces, ends: where each starts."""
    return np.array([xxhash.xxh3_64_intdigest(data[ends[i] : ends[i + size] - 1]) - (1 << 63) for i in firsts], np.int64)


def confirmed(docs: DataFrame, chunks: DataFrame, candidates: DataFrame, least_words: int) -> DataFrame:
    """h and run, checkpointed, of the candidates (checkpointed) below least_words words that lie in a repeated passage of so many.

    Around each chunk of such a run, and around the same chunk wherever else it stands, windows of least_words words are
    hashed; a run is in a passage if another text has one of its windows. Equal windows have the same least hash of half
    their words, so windows are compared only where that one stands in another text.
    """
    doubtful = candidates.where(F.col("run_words") < least_words)
    digests = cut_lineage(doubtful.select("digest").distinct())
    places = narrowed(candidates, digests, "digest").groupBy("h", "run").agg(F.collect_set(F.floor(F.col("place") % NUMBER / START)).alias("starts"))
    of_text = places.groupBy("h").agg(F.collect_list("run").alias("runs"), F.collect_list("starts").alias("starts"))
    firsts = chunks.groupBy("h").agg(F.min("doc_id").alias("first"))
    asked = cut_lineage(of_text.join(firsts, "h").select(F.col("h").alias("g"), "first", "runs", F.flatten("starts").alias("places"), F.transform("starts", F.size).alias("sizes")))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    # The number of texts asked for grows with the corpus, so both sides are shuffled at every size.
    owned = texts.join(asked, (texts["h"] == asked["g"]) & texts["doc_id"].eqNullSafe(asked["first"])).select("h", "text", "runs", "places", "sizes")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        owners, numbers, leasts, windows = [], [], [], []
        for h, text, own_runs, starts, sizes in zip(*(batch.column(c).to_pylist() for c in ("h", "text", "runs", "places", "sizes")), strict=True):
            spans = [m.span() for m in WORD.finditer(text)]
            words = [text[a:b].encode("utf-8", "surrogatepass") for a, b in spans]
            ends = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
            begins, data, at = np.array([a for a, _ in spans]), b" ".join(words), 0
            for run, n in zip(own_runs, sizes, strict=True):
                inside = np.searchsorted(begins, starts[at : at + n])
                at += n
                firsts = sorted({i for k in inside.tolist() for i in range(max(0, k - least_words + 1), min(k, len(spans) - least_words) + 1)})
                found = {}
                for block in np.split(firsts, np.flatnonzero(np.diff(firsts) > 1) + 1) if firsts else []:
                    i, j = int(block[0]), int(block[-1]) + 1
                    halves = hashed(data, ends, half, range(i, j + least_words - half))
                    for least, w in zip(sliding_window_view(halves, least_words - half + 1).min(1).tolist(), hashed(data, ends, least_words, range(i, j)).tolist(), strict=True):
                        found.setdefault(least, set()).add(w)
                owners += [h] * len(found)
                numbers += [run] * len(found)
                leasts += found
                windows += map(list, found.values())
        arrays = [pa.array(owners, pa.int64()), pa.array(numbers, pa.int64()), pa.array(leasts, pa.int64()), pa.array(windows, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["h", "run", "least", "windows"])

    def shared(each: DataFrame, key: str) -> DataFrame:
        return cut_lineage(each.groupBy(key).agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select(key))

    half = max(1, least_words // 2)
    each, folder = stored(map_batches(owned, rows, "h long, run long, least long, windows array<long>"), "passage-windows")
    near = narrowed(each, shared(each, "least"), "least").select("h", "run", F.explode("windows").alias("w"))
    sure = cut_lineage(narrowed(near, shared(near, "w"), "w").select("h", "run").distinct())
    removed(docs.sparkSession, folder)
    return sure


def passages(docs: DataFrame, chunks: DataFrame, least_words: int) -> tuple[DataFrame, DataFrame]:
    """All repeated chunks (h, digest, place), and those that lie in passages of least_words words and more, with run and
    run_words."""
    found = cut_lineage(repeated_chunks(chunks))
    candidates = cut_lineage(runs(found).where(F.col("run_words") >= min(RUN_WORDS, least_words)))
    sure = confirmed(docs, chunks, candidates, least_words)
    long = candidates.where(F.col("run_words") >= least_words)
    return found, cut_lineage(long.unionByName(candidates.where(F.col("run_words") < least_words).join(small(sure), ["h", "run"], "left_semi")))


def spans_of(chunks: DataFrame, kept: DataFrame, least_words: int) -> DataFrame:
    """h, n_words, n_copies, longest, spans of the texts with passages, or with copies."""
    spans = kept.groupBy("h", "run").agg(F.floor(F.min(F.col("place")) % NUMBER / START).alias("start"), F.first("run_words").alias("words"))
    of_text = spans.groupBy("h").agg(F.max("words").alias("longest"), F.sort_array(F.collect_list(F.struct("start", "words"))).alias("spans"))
    copies = chunks.groupBy("h").agg(F.count("*").alias("n_copies"), F.first("n_words").alias("n_words"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("words")))
    copied = (F.col("n_copies") > 1) & (F.col("n_words") >= least_words)
    texts = copies.join(of_text, "h", "left").where(copied | F.col("longest").isNotNull())
    return texts.select("h", "n_words", "n_copies", F.when(copied, F.col("n_words")).otherwise(F.col("longest")).alias("longest"), F.when(copied, whole).otherwise(F.col("spans")).alias("spans"))


def plan(chunks: DataFrame, found: DataFrame, kept: DataFrame, least_words: int) -> DataFrame:
    """What goes from each text: h, d (doc_id of the first document with it), drop (numbers of chunks), copied (other
    documents with the text lose it as a whole)."""
    texts = chunks.groupBy("h").agg(F.min("doc_id").alias("d"), F.first("n_words").alias("n_words"), F.count("*").alias("n"))
    owners = cut_lineage(texts)
    place = F.struct("d", "h", "place")
    firsts = cut_lineage(found.join(small(owners.select("h", "d")), "h").groupBy("digest").agg(F.min(place).alias("f")).select("digest", F.col("f.h").alias("first_h"), F.col("f.place").alias("first_place")))
    going = kept.join(small(firsts), "digest").where((F.col("h") != F.col("first_h")) | (F.col("place") != F.col("first_place")))
    drops = going.groupBy("h").agg(F.collect_set(F.floor(F.col("place") / NUMBER)).alias("drop"))
    return owners.join(drops, "h", "left").select("h", "d", "drop", ((F.col("n") > 1) & (F.col("n_words") >= least_words)).alias("copied")).where(F.col("drop").isNotNull() | F.col("copied"))


def stripped(batch: pa.RecordBatch, text: str, drop: str, gone: str) -> list[str | None]:
    """The texts of a batch without their dropped chunks."""
    kept = []
    for x, numbers, all_of_it in zip(*(batch.column(c).to_pylist() for c in (text, drop, gone)), strict=True):
        if all_of_it:
            x = ""
        elif numbers:
            ends, out = boundaries(code_points(x), SIZES), set(numbers)
            x = "".join(x[a:b] for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if i not in out)
        kept.append(x)
    return kept


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Documents with passages that stand in other documents too, and what deduplication leaves of them; one row for each.

    docs: doc_id, text, further columns are left out. Returns doc_id, n_words, n_copies (documents of the same text,
    itself included), longest (words of its longest repeated passage, as whole chunks), spans (start in code points
    and words of each), kept_chars and kept_sha256 (of the text after `dedup`). A passage counts from least_words words on;
    documents without one are left out.

    Null, empty and short texts are never repeated; repeated rows are copies of each other; rows with a null doc_id are
    kept as such; no rows give no rows; texts may have any length.
    """
    chunks, folder = stored(chunked(docs), "chunks")
    found, kept = passages(docs, chunks, least_words)
    named = spans_of(chunks, kept, least_words).join(plan(chunks, found, kept, least_words), "h", "left")
    named = cut_lineage(named.withColumnRenamed("h", "g"))
    removed(docs.sparkSession, folder)
    texts = docs.select("doc_id", "text")
    joined = texts.join(named, F.xxhash64(texts["text"]) == named["g"])
    gone = F.coalesce("copied", F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col("d"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        left = stripped(batch, "text", "drop", "gone")
        columns = [*(batch.column(c) for c in REPORT[:5]), pa.array([len(x) for x in left], pa.int64()), pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in left], pa.string())]
        return pa.RecordBatch.from_arrays(columns, REPORT)

    kinds = "doc_id long, n_words long, n_copies long, longest long, spans array<struct<start: bigint, words: bigint>>, kept_chars long, kept_sha256 string"
    return map_batches(joined.select(*REPORT[:5], "text", "drop", gone.alias("gone")), rows, kinds)


REPORT = ["doc_id", "n_words", "n_copies", "longest", "spans", "kept_chars", "kept_sha256"]


def dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents, stripped of chunks that stand in an earlier document, where these are part of a passage that counts.

    All columns stay, whatever their names. Earlier means the smaller doc_id (null first), then the smaller hash of the
    text. Texts that are equal to an earlier one as a whole become empty if they are long enough to count; repeated rows
    of one doc_id and text stay both. Null, empty and short texts stay as they are; texts may have any length; no rows
    give no rows.
    """
    chunks, folder = stored(chunked(docs), "chunks")
    going = cut_lineage(plan(chunks, *passages(docs, chunks, least_words), least_words))
    removed(docs.sparkSession, folder)
    joined = docs.join(going, F.xxhash64(docs["text"]) == going["h"], "left")
    gone = F.coalesce(going["copied"], F.lit(False)) & ~docs["doc_id"].eqNullSafe(going["d"])

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = pa.array(stripped(batch, "text", drop_name, gone_name), pa.string())
        return pa.RecordBatch.from_arrays([kept if c == "text" else batch.column(c) for c in names], names)

    names = docs.columns
    drop_name, gone_name = ("_" * (1 + max(map(len, names))) + c for c in ("drop", "gone"))  # longer than any name of the table
    return map_batches(joined.select(*[docs[quoted(c)] for c in names], going["drop"].alias(drop_name), gone.alias(gone_name)), rows, docs.schema)
