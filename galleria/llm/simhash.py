"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most r of 64 bits agree on whole blocks of them, so each fingerprint is dealt to one
bucket for every choice of agreeing blocks; two that link share a bucket. In a bucket the fingerprints are sorted by Gray
rank, which puts those with few differing bits near each other; a node stands for a run of them and holds the pattern of
the bits they all share. Bits that a node above holds are factored out of the nodes below, so a search adds up the
differences on its way down and leaves whole groups as soon as the sum exceeds r.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from galleria.llm.common import cut_lineage, map_batches, narrowed, shuffle_parts, small, texts_of, written

#: Children of a node of the index, and fingerprints that are looked up together.
FAN_OUT, TOGETHER = 8, 2048
#: Rows of whole buckets that are indexed at once.
AT_ONCE = 1 << 16
#: A bucket of more fingerprints is dealt out once more by blocks of its other bits.
MOST = 2048
#: One of so many texts is asked which shingles are common; how many of these are told apart at most.
ASKED, COMMON = 2, 1 << 20
#: Neighbours of a shared key compared in the first round, one more than that; each further round reaches so much wider.
FIRST_REACH, WIDER = 8, 4
#: Links that one task takes where they are joined to components.
EDGES_A_PART = 250_000


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case and all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def simhash(text: str, shingle: int = 3) -> int:
    """64-bit fingerprint: a bit is set if it is set in over half of the shingles' hashes; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))[:n].tolist()
    ends = stops[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)
    return fold(hashes)


def fold(hashes: np.ndarray) -> int:
    """Majority of each bit; long texts are counted in pieces to bound memory."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([simhash(t or "", shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), rows, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence: each bit is the parity of the bits from the top down to it."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Index:
    """Hierarchical index of the fingerprints of some buckets; those of a bucket are distinct."""

    def __init__(self, codes: np.ndarray, buckets: np.ndarray):
        order = np.lexsort((gray_rank(codes), buckets))
        self.codes, self.buckets = codes[order], buckets[order]
        #: From the top level down: pattern of the shared bits, which bits it holds that no node above holds, and the
        #: first and last bucket below the node.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        level = (self.codes, np.full(len(codes), np.uint64(2**64 - 1)), self.buckets, self.buckets)
        built = [level]
        while len(level[0]) > FAN_OUT:
            pattern, shared, low, high = level
            cuts = np.arange(0, len(pattern), FAN_OUT)
            every, some = np.bitwise_and.reduceat(pattern | ~shared, cuts), np.bitwise_or.reduceat(pattern & shared, cuts)
            shared = np.bitwise_and.reduceat(shared, cuts) & ~(every ^ some)
            level = (every & shared, shared, np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts))
            built.append(level)
        above = None
        for pattern, shared, low, high in reversed(built):
            self.levels.append((pattern, shared if above is None else shared & ~above[np.arange(len(shared)) // FAN_OUT], low, high))
            above = shared

    def within(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places (the first one less) of two fingerprints of a bucket that differ in at most radius bits, and in how many."""
        for first in range(0, len(self.codes), TOGETHER):
            asked = np.arange(first, min(first + TOGETHER, len(self.codes)))
            top = len(self.levels[0][0])
            who, node, off = np.repeat(asked, top), np.tile(np.arange(top), len(asked)), np.zeros(len(asked) * top, np.uint8)
            for depth, (pattern, own, low, high) in enumerate(self.levels):
                if depth:
                    who, off = np.repeat(who, FAN_OUT), np.repeat(off, FAN_OUT)
                    node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                    real = node < len(pattern)
                    who, off, node = who[real], off[real], node[real]
                # Some place below a node comes after the asked one, or the pair is found from the other side.
                reach, bucket = FAN_OUT ** (len(self.levels) - 1 - depth), self.buckets[who]
                keep = ((node + 1) * reach - 1 > who) & (low[node] <= bucket) & (bucket <= high[node])
                who, off, node = who[keep], off[keep], node[keep]
                off = off + np.bitwise_count((self.codes[who] ^ pattern[node]) & own[node])
                keep = off <= radius
                who, off, node = who[keep], off[keep], node[keep]
            yield who, node, off


def forest(n: int, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of n places under all found pairs; the closest pairs of a block come first."""
    root, taken = np.arange(n), []
    for a, b, off in found:
        for d in np.unique(off):
            x, y = a[off == d], b[off == d]
            while True:
                u, v = root[x], root[y]
                apart = u != v
                if not apart.any():
                    break
                x, y, u, v = x[apart], y[apart], u[apart], v[apart]
                high, low = np.maximum(u, v), np.minimum(u, v)
                hung, which = np.unique(high, return_index=True)  # each root is hung below one other, smaller one
                root[hung] = low[which]
                taken.append(np.stack([x[which], y[which]]))
                while (lower := root[root]).tobytes() != root.tobytes():
                    root = lower
    if not taken:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(taken, axis=1))


def block_masks(bits: list[int], blocks: int, radius: int) -> list[int]:
    """Masks of the bits that agree in at least one of them, for any two codes that differ in at most radius bits."""
    cut = [bits[i * len(bits) // blocks : (i + 1) * len(bits) // blocks] for i in range(blocks)]
    return [sum(1 << b for part in chosen for b in part) for chosen in combinations(cut, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_in_buckets(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links a, b of a spanning forest of each bucket's pairs within radius. Rows of a bucket meet in one task, sorted."""
    def search(codes: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
        index = Index(codes.view(np.uint64), buckets)
        first, second = forest(len(codes), index.within(radius))
        found = index.codes.view(np.int64)
        x, y = found[first], found[second]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0
        for batch in batches:
            kept.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fp", *keys)]))
            size += batch.num_rows
            if size >= AT_ONCE:
                rows = np.concatenate(kept, axis=1)
                starts = np.flatnonzero((rows[1:, 1:] != rows[1:, :-1]).any(0)) + 1
                if len(starts):
                    cut = starts[-1]
                    yield search(rows[0, :cut], np.searchsorted(starts, np.arange(cut), side="right"))
                    rows = rows[:, cut:]
                kept, size = [rows], rows.shape[1]
        if size:
            rows = np.concatenate(kept, axis=1)
            starts = np.flatnonzero((rows[1:, 1:] != rows[1:, :-1]).any(0)) + 1
            yield search(rows[0], np.searchsorted(starts, np.arange(size), side="right"))

    return rows.repartition(shuffle_parts(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Links a, b (a < b) whose components are those of all pairs within radius; fps has distinct values of fp.

    Buckets of over MOST fingerprints are dealt out by blocks of their free bits too, so that what one task searches
    together stays small whatever the data.
    """
    masks = block_masks(list(range(64)), blocks, radius)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(masks)])).alias("x")).select("fp", "x.m", "x.k")
    large = cut_lineage(keyed.groupBy("m", "k").count().where(F.col("count") > MOST).select("m", "k"))
    if large.isEmpty():
        return linked_in_buckets(keyed, ["m", "k"], radius)
    # Each mask leaves some bits free; two codes of a bucket differ in these only, in at most radius of them.
    free = [[b for b in range(64) if not m >> b & 1] for m in masks]
    again = F.array(*[F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("l")) for j, m in enumerate(block_masks(bits, radius + 2, radius))]) for bits in free])
    hot = keyed.join(large, ["m", "k"], "left_semi").select("fp", "m", "k", F.explode(F.element_at(again, F.col("m") + 1)).alias("y")).select("fp", "m", "k", "y.j", "y.l")
    rest = keyed.join(large, ["m", "k"], "left_anti")
    return linked_in_buckets(rest, ["m", "k"], radius).unionByName(linked_in_buckets(hot, ["m", "k", "j", "l"], radius))


def parts_for(rows: int) -> int:
    """Partitions of a narrow table of so many rows: few rows don't need as many tasks and files as the corpus."""
    return max(1, -(-rows // EDGES_A_PART))


def components(edges: DataFrame) -> DataFrame:
    """Members (node, root) of the components of edges (a, b), root their smallest member, by alternating stars.

    Every round lets the neighbours of a node link to the smallest one among them: first the larger neighbours, then the
    smaller ones. All rows stay in DataFrames, in as many partitions as their number asks for; each round is written to the
    checkpoint folder.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before, now = None, state(edges)
    while now != before:
        k = parts_for(now[0])
        edges = edges.coalesce(k)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(k)
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").coalesce(k).distinct().coalesce(k)
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")).coalesce(k)
        small = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        edges = cut_lineage(small.unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a < b").coalesce(k).distinct().coalesce(k))
        before, now = now, state(edges)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def compact(df: DataFrame) -> DataFrame:
    """A narrow table, checkpointed and in as many partitions as its rows ask for."""
    df = cut_lineage(df)
    return df.coalesce(parts_for(df.count()))


def groups(edges: DataFrame, node: str = "u") -> DataFrame:
    """Node and group (the same node for all that are linked) of the nodes that edges link."""
    found = components(edges)
    return found.select(F.col("node").alias(node), F.col("root").alias("group")).unionByName(found.select(F.col("root").alias(node), F.col("root").alias("group")).distinct())


def near_duplicates(docs: DataFrame, radius: int = 2, blocks: int = 4, shingle: int = 3) -> DataFrame:
    """Fingerprint and component of every document.

    docs: doc_id, text, further columns are left out. Returns doc_id, fingerprint (16 lower-case hex digits) and
    component_id: the smallest doc_id that can be reached over links of fingerprints that differ in at most radius bits.
    Null and wordless texts have fingerprint zero and link like any other; repeated rows are documents of their own; a
    null doc_id is a document, but names a component only where no other doc_id is in it; no rows give no rows.
    """
    known = cut_lineage(fingerprints(docs, shingle))
    firsts = cut_lineage(known.groupBy("fp").agg(F.min("doc_id").alias("first")))
    grouped = groups(links(firsts.select("fp"), radius, blocks), "fp")
    named = firsts.join(grouped, "fp", "left").select("fp", "first", F.coalesce("group", "fp").alias("group"))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    of_fp = named.join(least, "group").select("fp", "component_id")
    return known.join(of_fp, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: str, size: int) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similarity(a: str, b: str, size: int = 5) -> float:
    """Jaccard likeness of the sets of word shingles; 1 for two wordless texts."""
    x, y = shingle_set(a, size), shingle_set(b, size)
    return len(x & y) / len(x | y) if x or y else 1.0


def shingle_keys(text: str, size: int = 5) -> np.ndarray:
    """Sorted hashes of the set of word shingles: equal shingles have equal hashes."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    each = np.array([xxhash.xxh64_intdigest(w, 7) for w in words], np.uint64)
    n = max(1, len(words) - size + 1)
    keys = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    return np.unique(keys ^ (keys >> np.uint64(32)))


def prefix(keys: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The rarest keys of a text, so many that two texts with a likeness of `least` share one; rare ones come first.

    common: sorted keys that are known to be common, with their counts. Any order of the keys that is the same for all
    texts gives the same pairs; rare ones first makes them few.
    """
    if not len(keys):
        return keys
    take = len(keys) - math.ceil(least * len(keys) - 1e-9) + 1
    at = np.minimum(np.searchsorted(common, keys), max(len(common) - 1, 0))
    rank = np.where(common[at] == keys, counts[at], 0) if len(common) else np.zeros(len(keys), np.int64)
    return keys[np.lexsort((keys, rank))[:take]]


def common_keys(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in three texts or more of a fixed share of all texts (h, text), sorted, and in how many.

    The share doesn't shrink as the texts get more, or shingles of ever longer lists would pass for rare ones. Of more than
    COMMON shingles the most frequent stay. They only order the keys: no text and no key is left out of what is compared.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_keys(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["key"])

    keys = map_batches(texts.where(F.pmod("h", F.lit(ASKED)) == 0).select("text"), rows, "key long")
    counted = cut_lineage(keys.groupBy("key").count().where("count > 2"))
    least, total = 3, 0
    for n, many in counted.groupBy("count").agg(F.count("*")).orderBy(F.desc("count")).collect():
        total += many
        if total > COMMON:
            least = n + 1
            break
    found = counted.where(F.col("count") >= least).toArrow()
    keys, counts = found.column("key").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def confirmed(edges: DataFrame, asked: DataFrame, hashed: DataFrame, least: float) -> DataFrame:
    """The edges a, b (checkpointed) that are at least so alike; asked: u and the key (d, g) of its text's row in hashed
    (doc_id, h, text).

    Only texts of the edges' ends are moved: each once, and that of one end once more for each edge.
    """
    edges = edges.coalesce(parts_for(edges.count()))
    ends = edges.select(F.col("a").alias("u")).unionByName(edges.select(F.col("b").alias("u"))).distinct()
    now = cut_lineage(asked.join(ends, "u", "left_semi"))
    of = hashed.join(small(now), hashed["doc_id"].eqNullSafe(now["d"]) & (hashed["h"] == now["g"])).select("u", "text")
    with_x = of.select(F.col("u").alias("a"), F.col("text").alias("x")).join(small(edges), "a")
    pairs = with_x.join(of.select(F.col("u").alias("b"), F.col("text").alias("y")), "b")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        alike = [similarity(x or "", y or "") >= least for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return map_batches(pairs.select("a", "b", "x", "y"), rows, "a long, b long")


SHARING = "a long, b long, key long, n int, pos int"


def sharing(rows: DataFrame, low: int, high: int, least: float, rest: bool = False) -> DataFrame:
    """Pairs a, b of texts of different groups that share a key and can be alike, low to high - 1 places apart in its list.

    rows: key, u, r (group), n (shingles of the text), pos (of the key in the text's order); a key's list is ordered by
    u. A pair can be alike if its sizes allow it and enough of both texts comes from its first common key on. With rest,
    the rows of lists that are longer than high come out too (u as a, with key, n and pos), for a later round.
    """

    def columns(a: np.ndarray, b: np.ndarray | None = None, *more: np.ndarray) -> pa.RecordBatch:
        none = lambda kind: pa.nulls(len(a), kind)
        key, n, pos = (pa.array(more[0]), *(pa.array(x.astype(np.int32)) for x in more[1:])) if more else (none(pa.int64()), none(pa.int32()), none(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(a), none(pa.int64()) if b is None else pa.array(b), key, n, pos], ["a", "b", "key", "n", "pos"])

    def compare(x: np.ndarray, new: int) -> Iterator[pa.RecordBatch]:
        key, u, r, n, pos = x
        for d in range(low, min(high, len(key))):
            i = max(0, new - d)  # the second one of a pair wasn't there before
            one, two = slice(i, len(key) - d), slice(i + d, len(key))
            y = np.flatnonzero((key[one] == key[two]) & (r[one] != r[two])) + i
            z = y + d
            both, from_here = n[y] + n[z], np.minimum(n[y] - pos[y], n[z] - pos[z])
            can = (np.minimum(n[y], n[z]) >= least * np.maximum(n[y], n[z]) - 1e-6) & (from_here >= least / (1 + least) * both - 1e-6)
            if can.any():
                a, b = u[y[can]], u[z[can]]
                yield columns(np.minimum(a, b), np.maximum(a, b))
        if rest and len(key) > high:
            far = np.zeros(len(key), bool)  # rows with one of the same key high places before
            far[high:] = key[high:] == key[:-high]
            far[:new] = False
            start = far & ~np.concatenate([[False], (key[1:] == key[:-1]) & far[:-1]])
            if new:  # a list that was long already goes on: what stands before was given out
                carried = key[new - 1] == key[new] and new > high and key[new - 1 - high] == key[new - 1]
                start[new] &= not carried
            out = far.copy()
            for i in np.flatnonzero(start):
                out[i - high : i] = True
            if out.any():
                yield columns(u[out], None, key[out], n[out], pos[out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, kept, size = np.zeros((5, 0), np.int64), [], 0
        for batch in batches:
            kept.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "u", "r", "n", "pos")]))
            size += batch.num_rows
            if size >= AT_ONCE:
                x = np.concatenate([old, *kept], axis=1)
                yield from compare(x, old.shape[1])
                old, kept, size = x[:, -high - 1 :], [], 0
        if size:
            yield from compare(np.concatenate([old, *kept], axis=1), old.shape[1])

    sorted_rows = rows.repartition(shuffle_parts(rows.sparkSession), "key").sortWithinPartitions("key", "u").select("key", "u", "r", "n", "pos")
    return sorted_rows.mapInArrow(run, SHARING)


def merged(links_now: DataFrame, grouped: DataFrame) -> DataFrame:
    """u and group after more links."""
    before = grouped.where("u != group").select(F.col("u").alias("a"), F.col("group").alias("b"))
    return compact(groups(links_now.unionByName(before)))


def alike(keyed: DataFrame, asked: DataFrame, hashed: DataFrame, start: DataFrame, least: float) -> DataFrame:
    """u and group of the texts that a chain of confirmed links joins to others.

    start: first candidates a, b (checkpointed). keyed: u, n and keys (rarest first) of each text. Every pair of texts
    that share a key is compared in some round unless its texts are in one group by then, so the groups are those of all
    pairs.
    """
    grouped = compact(groups(confirmed(start, asked, hashed, least)))
    placed = keyed.join(small(grouped), "u", "left").select("u", F.coalesce("group", "u").alias("r"), "n", F.posexplode("keys").alias("pos", "key"))
    found = written(sharing(placed, 1, FIRST_REACH, least, rest=True), "near-pairs")
    rest = found.where("b IS NULL").select("key", F.col("a").alias("u"), "n", "pos").distinct()
    pairs, low, high = compact(found.where("b IS NOT NULL").select("a", "b").distinct()), FIRST_REACH, WIDER * FIRST_REACH
    while True:
        if not pairs.isEmpty():
            links_now = compact(confirmed(pairs, asked, hashed, least))
            if not links_now.isEmpty():
                grouped = merged(links_now, grouped)
        placed = written(compact(rest).join(small(grouped), "u", "left").withColumn("r", F.coalesce("group", "u")).drop("group"), "near-rest")
        # Lists that are long enough and whose texts aren't all of one group by now; only these go on.
        open_keys = compact(placed.groupBy("key").agg(F.min("r").alias("x"), F.max("r").alias("y"), F.count("*").alias("m")).where((F.col("x") != F.col("y")) & (F.col("m") > low)).select("key"))
        if open_keys.isEmpty():
            return grouped
        going = narrowed(placed, open_keys, "key")
        pairs = compact(sharing(going, low, high, least).select("a", "b").distinct())
        rest, low, high = going.select("key", "u", "n", "pos"), high, WIDER * high


def drop_near_duplicates(docs: DataFrame, radius: int = 6, blocks: int = 8, least: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates, all columns as they are: the one of the smallest doc_id.

    A link holds if two texts share at least `least` of their five-word shingles, whatever their fingerprints. Links of
    fingerprints within radius, and of different texts of one fingerprint, are confirmed first; all further links are
    found by the rarest shingles, of which two such texts share one. Texts of the same words are one. Null, empty and
    wordless texts are one group; texts may have any length; of repeated rows one stays; null doc_ids come first in the
    order; columns that docs has besides stay as they are; no rows give no rows.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))

    def prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        fps = np.array([simhash(t) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fps), pa.array(word_ids(texts))], ["doc_id", "h", "fp", "u"])

    known = cut_lineage(map_batches(hashed, prints, "doc_id long, h long, fp long, u long"))
    # One row for each text; texts of the same words have the same fingerprint and keys.
    firsts = cut_lineage(known.groupBy("u").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.first("fp").alias("fp")))
    heads = cut_lineage(firsts.groupBy("fp").agg(F.min("u").alias("u")))
    near = links(heads.select("fp"), radius, blocks).distinct()
    near = near.join(heads.select(F.col("fp").alias("a"), F.col("u").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("u").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = firsts.select("fp", F.col("u").alias("b")).join(heads.select("fp", F.col("u").alias("a")), "fp").where("a != b").select("a", "b")
    start = cut_lineage(near.unionByName(same))

    # Copies are told by their row; one text of each is enough.
    copies = known.join(firsts.select("first"), known["doc_id"].eqNullSafe(F.col("first.doc_id")) & (known["h"] == F.col("first.h")), "left_anti")
    copies = cut_lineage(copies.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).distinct())
    once = hashed.join(small(copies), hashed["doc_id"].eqNullSafe(copies["__d"]) & (hashed["h"] == copies["__h"]), "left_anti")
    common, counts = common_keys(once)

    def rarest(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        every = [shingle_keys(t) for t in texts]
        first = [prefix(k, common, counts, least).view(np.int64) for k in every]
        return pa.RecordBatch.from_arrays([pa.array(word_ids(texts)), pa.array([len(k) for k in every], pa.int32()), pa.array(first, pa.list_(pa.int64()))], ["u", "n", "keys"])

    keyed = map_batches(once.select("text"), rarest, "u long, n int, keys array<long>")
    asked = firsts.select("u", F.col("first.doc_id").alias("d"), F.col("first.h").alias("g"))
    grouped = alike(keyed, asked, hashed, start, least)
    stays = firsts.join(grouped, "u", "left").groupBy(F.coalesce("group", "u").alias("group")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("d"), F.col("first.h").alias("g"))
    # Fewer rows go than stay; they are few enough to be broadcast, or both sides are shuffled.
    gone = known.join(stays, known["doc_id"].eqNullSafe(stays["d"]) & (known["h"] == stays["g"]), "left_anti")
    gone = cut_lineage(gone.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).distinct())
    kept = docs.join(small(gone), docs["doc_id"].eqNullSafe(gone["__d"]) & (F.xxhash64(docs["text"]) == gone["__h"]), "left_anti")
    repeated = known.groupBy("doc_id", "h").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def word_ids(texts: list[str]) -> np.ndarray:
    """A hash of each text's words."""
    return np.array([xxhash.xxh64_intdigest(b" ".join(words_of(t))) for t in texts], np.uint64).view(np.int64)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
