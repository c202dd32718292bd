"""Suffix-array dedup with sparse suffixes.

A passage is a repeat if at least LEAST words of it stand in two texts. Suffixes are retained at minimisers only: the
places whose eight-word hash is the least of WINDOW neighbouring ones. The first WINDOW places of any repeat hold one, in
both texts alike, with at least PREFIX words of the repeat after it. So suffixes whose first PREFIX words stand in one
text only are left out; the others are sorted by what follows and, once more, by what comes before; neighbours are
compared and the match is extended to the left and the right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from galleria.llm.chunks import scrambled
from galleria.llm.common import cut_lineage, map_batches, shuffle_parts, texts_of, written

#: Words of the shortest repeat, of the hashed grams, and grams among which a minimiser is picked.
LEAST, GRAM, WINDOW = 50, 8, 32
#: Words that a repeat has from its first minimiser on, and words that are compared beyond on either side.
PREFIX = LEAST - WINDOW + 1
BEYOND = LEAST - PREFIX

#: Odd factors of the polynomial hashes over bytes and over words.
BYTE_FACTOR, WORD_FACTOR = 0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F
SUFFIXES = "doc_id long, h long, n_words long, at array<int>, keys array<long>"


class Powers:
    """Powers of an odd factor and of its inverse modulo 2**64, as far as they were asked for."""

    def __init__(self, factor: int):
        self.factors = (factor, pow(factor, -1, 1 << 64))
        self.known = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known[0]) < n:
            size = 1 << (n - 1).bit_length()
            self.known = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, f, np.uint64)]), dtype=np.uint64) for f in self.factors]
        return self.known[0][:n], self.known[1][:n]


BYTE_POWERS, WORD_POWERS = Powers(BYTE_FACTOR), Powers(WORD_FACTOR)


def spans_hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of each span of the values; equal spans have equal hashes wherever they stand."""
    up, down = powers.upto(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)])
    return scrambled((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space and control characters."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate([[False], data > 32, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    return spans_hashed(data.astype(np.uint64) + np.uint64(1), starts, ends, BYTE_POWERS)


def runs_hashed(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of so many words."""
    starts = np.arange(max(0, len(words) - size + 1))
    return spans_hashed(words, starts, starts + size, WORD_POWERS)


def minimisers(words: np.ndarray) -> np.ndarray:
    """Places of the retained suffixes of a text of at least LEAST words."""
    grams = runs_hashed(words, GRAM)
    found = []
    for first in range(0, len(grams) - WINDOW + 1, 1 << 16):  # long texts in pieces, to bound memory
        view = np.lib.stride_tricks.sliding_window_view(grams[first : first + (1 << 16) + WINDOW - 1], WINDOW)
        found.append(np.unique(view.argmin(1) + np.arange(len(view))) + first)
    return np.unique(np.concatenate(found))


def suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n_words, and of the retained suffixes: at (word) and keys (hash of PREFIX words)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, places, keys = [], [], []
        for text in texts_of(batch):
            words = word_hashes(text)
            sizes.append(len(words))
            at = minimisers(words) if len(words) >= LEAST else np.zeros(0, np.int64)
            at = at[at <= len(words) - PREFIX]
            places.append(at.astype(np.int32))
            keys.append(runs_hashed(words, PREFIX)[at].view(np.int64) if len(at) else np.zeros(0, np.int64))
        arrays = [batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "h", "n_words", "at", "keys"])

    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), rows, SUFFIXES)


def surroundings(texts: DataFrame) -> DataFrame:
    """key, h, at, after and before: BEYOND words behind the key's and before them (from near to far), four bytes each.

    texts: h, text, at (array of words). Beyond the text's ends stand zeros, which match nothing.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, owners, places, after, before = [], [], [], [], []
        for h, text, at in zip(*(batch.column(c).to_pylist() for c in ("h", "text", "at")), strict=True):
            words = word_hashes(text)
            at = np.array(sorted(at), np.int64)
            keys += runs_hashed(words, PREFIX)[at].view(np.int64).tolist()
            short = np.concatenate([np.zeros(BEYOND, np.uint32), (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.zeros(BEYOND, np.uint32)]).astype(">u4")
            steps = np.arange(BEYOND)
            after += [x.tobytes() for x in short[at[:, None] + BEYOND + PREFIX + steps]]
            before += [x.tobytes() for x in short[at[:, None] + BEYOND - 1 - steps]]
            owners += [h] * len(at)
            places += at.tolist()
        arrays = [pa.array(keys, pa.int64()), pa.array(owners, pa.int64()), pa.array(places, pa.int32()), pa.array(after, pa.binary()), pa.array(before, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["key", "h", "at", "after", "before"])

    return map_batches(texts, rows, "key long, h long, at int, after binary, before binary")


def common_words(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of leading words that two rows of words share."""
    same = (x == y) & (x != 0)
    return np.where(same.all(1), same.shape[1], same.argmin(1))


def windows_between(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The windows of LEAST words that a match holds, as bits: bit j for the one that starts j words before the suffix.

    left, right: words of the match before the suffix and behind its first PREFIX words.
    """
    low = (BEYOND - right).astype(np.int64)
    return np.where(left >= low, (np.int64(1) << (left.astype(np.int64) + 1)) - (np.int64(1) << np.minimum(low, left)), 0)


class Rows:
    """Sorted suffixes: numbers (key, h, at) and the words around them, the sorted side first."""

    def __init__(self, numbers: np.ndarray, near: np.ndarray, far: np.ndarray):
        self.numbers, self.near, self.far = numbers, near, far

    def __len__(self) -> int:
        return self.numbers.shape[1]

    def __getitem__(self, at) -> Rows:
        return Rows(self.numbers[:, at], self.near[at], self.far[at])

    def then(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.numbers, other.numbers], axis=1), np.concatenate([self.near, other.near]), np.concatenate([self.far, other.far]))

    @staticmethod
    def of(batch: pa.RecordBatch, near: str, far: str) -> Rows:
        numbers = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "h", "at")])
        return Rows(numbers, *(np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u4").reshape(-1, BEYOND) for c in (near, far)))


FACTS = "key long, h long, at int, reach int, windows long, after binary, before binary"


def compared(rows: Rows, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row how far it matches any other text on the sorted side, and the windows that it shares with the nearest
    row of another text on either side. In sorted order the longest match is with one of these two."""
    key, h, _ = rows.numbers
    n = len(rows)
    edge = np.flatnonzero((key[1:] != key[:-1]) | (h[1:] != h[:-1])) + 1  # a run: rows of one key and text
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [n]])
    run = np.repeat(np.arange(len(starts)), ends - starts)
    reach, shared = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for other in (starts[run] - 1, ends[run]):
        i = np.flatnonzero((other >= 0) & (other < n))
        i = i[key[i] == key[other[i]]]
        j = other[i]
        near, far = common_words(rows.near[i], rows.near[j]), common_words(rows.far[i], rows.far[j])
        reach[i] = np.maximum(reach[i], near)
        shared[i] |= windows_between(far, near) if forward else windows_between(near, far)
    return reach, shared


def neighbours(sorted_rows: DataFrame, forward: bool, open_ends: bool = True) -> DataFrame:
    """FACTS of suffixes that come sorted by key and by what follows (forward) or by what comes before.

    One batch and the run before it are held at a time. With open_ends, rows at either end of a partition, whose
    neighbours may stand in another one, carry their words too, so that they can be compared once more.
    """
    near, far = ("after", "before") if forward else ("before", "after")

    def result(rows: Rows, skip: int, marks: np.ndarray) -> pa.RecordBatch:
        """FACTS of the rows from skip on; marks: rows that carry their words."""
        reach, shared = (x[skip:] for x in compared(rows, forward))
        own, marks = rows[np.arange(skip, len(rows))], marks[skip:]
        words = {near: own.near, far: own.far}
        sides = []
        for c in ("after", "before"):
            side: list[bytes | None] = [None] * len(own)
            for i in np.flatnonzero(marks):
                side[i] = words[c][i].tobytes()
            sides.append(pa.array(side, pa.binary()))
        key, h, at = own.numbers
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(h), pa.array(at.astype(np.int32)), pa.array(reach.astype(np.int32)), pa.array(shared), *sides], [c.split()[0] for c in FACTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, skip, first = None, 0, True  # skip: rows of held that have been given out
        for batch in batches:
            held = (x := Rows.of(batch, near, far)) if held is None else held.then(x := Rows.of(batch, near, far))
            key, h, _ = held.numbers
            edge = np.flatnonzero((key[1:] != key[:-1]) | (h[1:] != h[:-1])) + 1
            if len(edge) < 3:
                continue
            # All but the last run have both neighbours; the row before that run stays for it.
            cut = edge[-1]
            marks = np.zeros(cut + 1, bool)
            marks[cut - 1] = open_ends
            if first:
                marks[: edge[0] + 1] = open_ends
            yield result(held[np.arange(cut + 1)], skip, marks).slice(0, cut - skip)
            held, skip, first = held[np.arange(cut - 1, len(held))], 1, False
        if held is not None and len(held) > skip:
            yield result(held, skip, np.full(len(held), open_ends))

    return sorted_rows.mapInArrow(run, FACTS)


def facts(around: DataFrame) -> DataFrame:
    """FACTS of all suffixes in both orders, side telling which. Rows are dealt by ranges of the whole order, so that the
    suffixes of a frequent key are spread too; what lies at the edges of the ranges (a few rows each) is compared again."""
    parts = shuffle_parts(around.sparkSession)
    found = None
    for forward, order in ((True, ("after", "before")), (False, ("before", "after"))):
        columns = ["key", *order, "h", "at"]
        one = neighbours(around.repartitionByRange(parts, *columns).sortWithinPartitions(*columns), forward).withColumn("side", F.lit(int(forward)))
        found = one if found is None else found.unionByName(one)
    found = written(found, "suffix-neighbours")
    for forward, order in ((True, ("after", "before")), (False, ("before", "after"))):
        edges = found.where(F.col("after").isNotNull() & (F.col("side") == int(forward))).repartition(1).sortWithinPartitions("key", *order, "h", "at")
        found = found.unionByName(neighbours(edges, forward, open_ends=False).withColumn("side", F.lit(int(forward))))
    return found.select("key", "h", "at", "reach", "windows", "side")


def bit(i: Column) -> Column:
    """The long in which only that bit is set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def ones(low: Column, high: Column) -> Column:
    """Bits low to high of a long; none if high is less."""
    return F.when(high >= low, bit(high + 1) - bit(low)).otherwise(F.lit(0).cast("long"))


def repeated_windows(around: DataFrame) -> DataFrame:
    """h, at and the windows (bits) around each suffix that another text has too.

    Neighbours tell for each suffix the longest match on either side, and some windows that are shared for sure. Where
    windows are left that could be shared with a third text (a match that is longest on neither side), those are hashed
    and counted.
    """
    seen = facts(around).groupBy("h", "at", "key").agg(
        F.max(F.when(F.col("side") == 1, F.col("reach"))).alias("right"), F.max(F.when(F.col("side") == 0, F.col("reach"))).alias("left"), F.bit_or("windows").alias("sure")
    )
    possible = ones(BEYOND - F.coalesce("right", F.lit(0)), F.coalesce("left", F.lit(0)))
    seen = written(seen.select("h", "at", "key", "sure", possible.alias("possible")).where("possible <> 0"), "suffix-windows")
    keys = cut_lineage(seen.where("possible <> sure").select("key").distinct())
    sure = seen.where("sure <> 0").select("h", "at", "sure")
    if keys.isEmpty():
        return sure
    asked = seen.join(keys, "key", "left_semi").select("h", "at", "key", "possible")
    bits = F.filter(F.sequence(F.lit(0), F.lit(BEYOND)), lambda j: F.col("possible").bitwiseAND(bit(j)) != 0)
    each = around.join(asked, ["h", "at", "key"]).select("h", "at", "key", "after", "before", F.explode(bits).alias("j"))
    each = written(each.select("h", "at", "j", F.xxhash64("key", "j", F.substring("before", F.lit(1), 4 * F.col("j")), F.substring("after", F.lit(1), 4 * (BEYOND - F.col("j")))).alias("w")), "suffix-third-texts")
    shared = cut_lineage(each.groupBy("w").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("w"))
    more = each.join(shared, "w", "left_semi").groupBy("h", "at").agg(F.bit_or(bit(F.col("j"))).alias("sure"))
    return sure.unionByName(more).groupBy("h", "at").agg(F.bit_or("sure").alias("sure"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Documents with passages of at least LEAST words that stand in other documents too; one row for each.

    docs: doc_id, text, further columns are left out. Returns doc_id, n_words, n_copies (documents of the same text,
    itself included), n_repeated (words inside repeats), spans (start and end, in words, end exclusive, disjoint).

    Words are runs of characters above U+0020. Null, empty and short texts have no repeats; documents of equal text are
    repeats as a whole; repeated rows are such; rows with a null doc_id are kept as such; no rows give no rows; texts may
    have any length.
    """
    known = cut_lineage(suffixes(docs))
    rows = known.select("h", F.explode(F.arrays_zip("at", "keys")).alias("s")).select("h", F.col("s.at").alias("at"), F.col("s.keys").alias("key"))
    # Written first, so that the join reads two plain shuffles and Spark can split the rows of a hot key.
    shared = cut_lineage(rows.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key"))
    retained = rows.join(shared, "key", "left_semi").groupBy("h").agg(F.collect_set("at").alias("at"))
    copies = cut_lineage(known.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"), F.first("n_words").alias("n_words")))
    asked = retained.join(copies, "h").select(F.col("h").alias("g"), "first", "at")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    owned = texts.join(asked, (texts["h"] == asked["g"]) & texts["doc_id"].eqNullSafe(asked["first"])).select("h", "text", "at")
    around = written(surroundings(owned), "suffixes")
    highest, lowest = (F.length(F.bin(x)) - 1 for x in (F.col("sure"), F.col("sure").bitwiseAND(-F.col("sure"))))
    # All windows of a suffix hold its first PREFIX words, so together they are one span.
    found = repeated_windows(around).select("h", (F.col("at") - highest).alias("start"), (F.col("at") + LEAST - lowest).alias("end"))
    merged = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "end"))),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    of_text = found.groupBy("h").agg(merged.alias("spans"))
    copied = (F.col("n_copies") > 1) & (F.col("n_words") >= LEAST)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    named = copies.join(of_text, "h", "left").where(copied | F.col("spans").isNotNull()).select("h", "n_words", "n_copies", F.when(copied, whole).otherwise(F.col("spans")).alias("spans"))
    n_repeated = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return known.select("doc_id", "h").join(named, "h").select("doc_id", "n_words", "n_copies", n_repeated.alias("n_repeated"), "spans")
