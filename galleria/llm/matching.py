"""LM scoring by partial matching: a trie of byte contexts with escapes and symbol exclusion gives code lengths.

A symbol is a byte of a text's UTF-8 or END, which also stands before the text. A context is what the last 0 to ORDER
symbols are; its node counts the symbols that followed it in the training texts. The longest known context predicts; a
symbol that it hasn't seen is an escape to the next shorter one, where the symbols of the longer one are excluded, and at
last every symbol of 256 that is left is as likely as any other. Escapes are those of method D: of n occurrences of q
symbols each symbol gives half an occurrence to the escape. The longest contexts count every occurrence, a shorter one each
symbol once for every longer context in which it was seen (update exclusion).

The trie is a table of grams (context and symbol, ORDER + 1 bytes in a long). What a task must know to score its texts are
the grams that it meets. So blocks of texts say which grams and words they have, Spark counts these, the trie gives each
distinct gram its log probability once, and each block gets back the values of its own grams: what a task holds is bounded
by its block, and no table is broadcast but that of contexts of one byte and none (at most 65,792 rows). Words are known by
hashes of 64 bits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import fsum, log10

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from galleria.llm.common import bound_batches, map_batches, new_folder, removed, shuffle_parts, slices

#: Symbols that predict; a gram (context and symbol) fits a long.
ORDER = 5
#: No UTF-8 text has this byte.
END = 0xFF
SYMBOLS = 256
#: Bytes of text of a block, but for one slice more; small inputs have smaller blocks, one for each core.
BLOCK_BYTES = 48 << 20
#: Bytes of text that are looked at together; longer texts are cut at white space.
PIECE = 1 << 20
#: Keys of a block's pieces that are kept apart before they are merged; rows that are handed on together.
UNMERGED, ROWS = 1 << 20, 1 << 16
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: An odd multiplier of word hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

DOCS, GRAM, WORD = 0, 1, 2
NOTED = "block long, kind int, key long, n long, docs binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

Part = tuple[int, bytes, bytes, bytes]  # number of its text, what stands before it, the part, END after the last part


def portions(texts: list[bytes]) -> Iterator[list[Part]]:
    """The texts in lists of parts of about PIECE bytes together, so that no word is cut."""
    held, size = [], 0
    for number, text in enumerate(texts):
        start, before = 0, bytes([END]) * ORDER
        while True:
            end = len(text)
            if end - start > PIECE:
                found = max(text.rfind(bytes([b]), start, start + PIECE) for b in np.flatnonzero(BLANK))
                ahead = [i for b in np.flatnonzero(BLANK) if found <= start and (i := text.find(bytes([b]), start + PIECE)) >= 0]
                end = found if found > start else min(ahead, default=end)
            held.append((number, before, text[start:end], bytes([END]) if end == len(text) else b""))
            size += end - start
            if size >= PIECE:
                yield held
                held, size = [], 0
            if end == len(text):
                break
            before, start = (before + text[start:end])[-ORDER:], end
    if held:
        yield held


def grams(parts: list[Part], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each symbol of each part, and the number of each one's text."""
    raw = np.frombuffer(b"".join(before + part + end for _, before, part, end in parts), np.uint8)
    sizes = np.array([len(part) + len(end) for _, _, part, end in parts])
    at = np.arange(sizes.sum()) + np.repeat(np.arange(len(parts)) * order, sizes)
    out = np.zeros(len(at), np.int64)
    for i in range(order + 1):
        out = out << 8 | raw[at + i]
    return out, np.repeat([number for number, _, _, _ in parts], sizes)


def words(parts: list[Part]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word between ASCII white space, A-Z in lower case, and the number of its text."""
    joined = b"\n".join(part for _, _, part, _ in parts).lower()
    solid = ~BLANK[np.frombuffer(joined, np.uint8)]
    edges = np.flatnonzero(np.diff(np.r_[False, solid, False]))
    first, last = edges[::2], edges[1::2]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    powers = np.full(len(joined), BASE, np.uint64)
    powers[0] = 1
    sums = np.r_[np.uint64(0), np.cumsum((np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)) * np.cumprod(powers))]
    powers[1:] = INVERSE
    h = (sums[last] - sums[first]) * np.cumprod(powers)[first]
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    ends = np.cumsum([len(part) + 1 for _, _, part, _ in parts])
    return (h ^ (h >> np.uint64(32))).view(np.int64), np.array([number for number, _, _, _ in parts])[np.searchsorted(ends, first, side="right")]


class Counts:
    """Distinct keys and their counts."""

    def __init__(self) -> None:
        self.parts, self.unmerged = [], 0

    def add(self, keys: np.ndarray, times: int) -> None:
        found = pd.Series(keys).value_counts(sort=False)
        self.parts.append((found.index.to_numpy(np.int64), found.to_numpy(np.int64) * times))
        self.unmerged += len(found)
        if self.unmerged > UNMERGED:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 2
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[: len(keys)]
        merged = keys[first], np.add.reduceat(n, first) if len(first) else n
        self.parts, self.unmerged = [merged], 0
        return merged


FIELDS = [("block", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("docs", pa.binary())]
SMALLER = pa.ipc.IpcWriteOptions(compression="zstd")


def noted(block: int, kind: int, rows: int, **columns: object) -> pa.RecordBatch:
    columns |= {"block": np.full(rows, block), "kind": np.full(rows, kind)}
    return pa.RecordBatch.from_arrays([pa.array(columns[name], t) if name in columns else pa.nulls(rows, t) for name, t in FIELDS], [name for name, _ in FIELDS])


def bundle(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=SMALLER) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


class Block:
    """What the texts of a block have: training counts of grams and words; 0 for those of other texts only."""

    def __init__(self, number: int) -> None:
        self.number, self.size, self.counts = number, 0, {GRAM: Counts(), WORD: Counts()}

    def add(self, texts: list[bytes], learns: list[bool]) -> None:
        for wanted in (True, False):
            for parts in portions([t for t, x in zip(texts, learns, strict=True) if x is wanted]):
                self.counts[GRAM].add(grams(parts)[0], int(wanted))
                self.counts[WORD].add(words(parts)[0], int(wanted))
        self.size += sum(map(len, texts))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for kind, counts in self.counts.items():
            keys, n = counts.merge()
            for i in range(0, len(keys), ROWS):
                yield noted(self.number, kind, len(keys[i : i + ROWS]), key=keys[i : i + ROWS], n=n[i : i + ROWS])


def note(docs: DataFrame) -> DataFrame:
    """One pass over the texts: the documents dealt into blocks, and each block's grams and words. Returns NOTED.

    docs: doc_id, text, held_out, no nulls but in doc_id. Documents come in bundles: compressed Arrow streams.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(TaskContext.get().partitionId() << 32)
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            block.add([t.encode() for t in batch.column("text").to_pylist()], [not h for h in batch.column("held_out").to_pylist()])
            yield noted(block.number, DOCS, 1, docs=[bundle(batch)], n=[batch.num_rows - batch.column("held_out").true_count])
            if block.size >= BLOCK_BYTES:
                yield from block.rows()
                block = Block(block.number + 1)
        yield from block.rows()

    return docs.mapInArrow(run, NOTED)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands among sorted keys, and whether it does."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Trie:
    """The nodes of all contexts of some grams, and the log10 probability of each gram.

    seen: trained grams of ORDER + 1 bytes and their counts, sorted; all grams whose contexts end in the same two bytes or
    none of these. low: grams of two bytes and of one with their counts, of the whole corpus.
    """

    def __init__(self, seen: np.ndarray, n: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> None:
        self.order, self.counts, self.nodes = order, {order: (seen, n)}, {}
        for k in range(order - 1, 1, -1):
            self.counts[k] = np.unique(self.counts[k + 1][0] & ((1 << 8 * (k + 1)) - 1), return_counts=True)
        self.counts[1], self.counts[0] = low
        for k in range(order + 1):
            self.nodes[k] = self._nodes(k)

    def _nodes(self, k: int) -> tuple[np.ndarray, ...]:
        """Contexts of k bytes: their key, n, q, and what is left in the next shorter one when their symbols are excluded:
        occurrences, log10 of the escape from it (0 if no symbol is left)."""
        keys, c = self.counts[k]
        contexts = keys >> 8
        first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(keys) else np.zeros(0, np.int64)
        contexts, n, q = contexts[first], np.add.reduceat(c, first) if len(first) else c[:0], np.diff(np.r_[first, len(keys)])
        if k == 0:
            return contexts, n, q, SYMBOLS - q, np.zeros(len(q))
        shorter, shorter_n = self.counts[k - 1]
        excluded = shorter_n[np.searchsorted(shorter, keys & ((1 << 8 * k) - 1))]
        excluded = np.add.reduceat(excluded, first) if len(first) else excluded
        above = self.nodes[k - 1]
        at = np.searchsorted(above[0], contexts & ((1 << 8 * (k - 1)) - 1))
        left, kinds = above[1][at] - excluded, above[2][at] - q
        return contexts, n, q, left, np.where(kinds > 0, np.log10(np.maximum(kinds, 1) / (2 * np.maximum(left, 1))), 0.0)

    def log10(self, wanted: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's symbol after its context."""
        total = np.zeros(len(wanted))
        left = np.full(len(wanted), SYMBOLS)  # occurrences that aren't excluded in the context that is tried next
        escape = np.zeros(len(wanted))  # of that context
        fresh, todo = np.ones(len(wanted), bool), np.arange(len(wanted))
        for k in range(self.order, -1, -1):
            contexts, n, q, rest, onward = self.nodes[k]
            key = wanted[todo] & ((1 << 8 * (k + 1)) - 1)
            node, known = lookup(contexts, key >> 8)
            todo, key, node = todo[known], key[known], node[known]  # the others start at a shorter context
            rested = np.setdiff1d(np.flatnonzero(fresh), todo, assume_unique=True) if k else np.zeros(0, np.int64)
            new = fresh[todo]
            left[todo[new]], escape[todo[new]] = n[node[new]], np.log10(q[node[new]] / (2 * n[node[new]]))
            fresh[todo] = False
            at, hit = lookup(self.counts[k][0], key)
            total[todo[hit]] += np.log10((2 * self.counts[k][1][at[hit]] - 1) / (2 * left[todo[hit]]))
            todo, node = todo[~hit], node[~hit]
            total[todo] += escape[todo]
            left[todo], escape[todo] = rest[node], onward[node]
            todo = np.r_[todo, rested]
        missed = todo if len(self.counts[0][0]) else np.arange(len(wanted))
        total[missed] -= np.log10(left[missed])
        return total


def log_probabilities(counts: DataFrame) -> DataFrame:
    """Log10 probability of each gram (key, n; 0: not trained): key, value.

    Contexts that share their last two bytes meet in one task, which takes whole groups of them together.
    """
    spark = counts.sparkSession
    pairs = counts.where("n > 0").select(F.col("key").bitwiseAND(0xFFFFFF).alias("t")).distinct().groupBy(F.col("t").bitwiseAND(0xFFFF).alias("gram")).count()
    rows = sorted((r["gram"], r["count"]) for r in pairs.collect())  # at most 65,536
    keys, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    low = spark.sparkContext.broadcast([(keys, n), np.unique(keys & 0xFF, return_counts=True)])

    def values(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        g, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(g, kind="stable")
        g, c = g[order], c[order]
        found = Trie(g[c > 0], c[c > 0], low.value).log10(g)
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(found)], ["key", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            g, c = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            if not len(g):
                continue
            if size > ROWS:  # whole groups so far: what stands before the last change of the two bytes
                last = g >> 8 & 0xFFFF
                cut = np.flatnonzero(np.r_[(parts[-1][0][-1] >> 8 & 0xFFFF) != last[0], last[1:] != last[:-1]])
                if len(cut):
                    yield values([*parts, (g[: cut[-1]], c[: cut[-1]])])
                    parts, size, g, c = [], 0, g[cut[-1] :], c[cut[-1] :]
            parts.append((g, c))
            size += len(g)
        if parts:
            yield values(parts)

    ends = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    dealt = counts.select("key", "n", ends.alias("ends")).repartition(shuffle_parts(spark), "ends").sortWithinPartitions("ends")
    return dealt.mapInArrow(run, "key long, value double")


def scored(rows: DataFrame, end: float, end_known: int, scale: float) -> DataFrame:
    """Scores of documents that follow their block's grams and words in each partition. Returns RESULT."""
    names, types = [c.split()[0] for c in RESULT.split(", ")], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, tables = None, {}, {}
        for batch in batches:
            for piece in same(batch, "block"):
                if piece.column("block")[0].as_py() != block:
                    block, keys, tables = piece.column("block")[0].as_py(), {GRAM: [], WORD: []}, {}
                for part in same(piece, "kind"):
                    kind = part.column("kind")[0].as_py()
                    if kind != DOCS:
                        keys[kind].append((part.column("key").to_numpy().copy(), part.column("value").to_numpy().copy()))
                        continue
                    if not tables:
                        for k in list(keys):
                            own, values = (np.concatenate(x) for x in zip(*keys.pop(k), strict=True)) if keys[k] else (keys.pop(k), np.zeros(0))
                            tables[k] = pd.Index(own, dtype=np.int64), values
                    for docs in part.column("docs"):
                        yield judged(pa.ipc.open_stream(docs.as_buffer()).read_next_batch(), tables)

    def judged(docs: pa.RecordBatch, tables: dict[int, tuple[pd.Index, np.ndarray]]) -> pa.RecordBatch:
        n = docs.num_rows
        sums, base, n_words, n_known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for parts in portions([t.encode() for t in docs.column("text").to_pylist()]):
            keys, owner = grams(parts)
            sums += np.bincount(owner, tables[GRAM][1][tables[GRAM][0].get_indexer(keys)], n)
            keys, owner = words(parts)
            if len(keys):
                values = tables[WORD][1][tables[WORD][0].get_indexer(keys)]
                base += np.bincount(owner, values, n)
                n_words += np.bincount(owner, minlength=n)
                n_known += np.bincount(owner[values > 0], minlength=n)  # log10 of 1.5 and more
        columns = [docs.column("doc_id"), docs.column("held_out"), n_words + 1, n_known + end_known, base + end - scale * (n_words + 1), sums]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return rows.mapInArrow(run, RESULT)


def same(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """The stretches of a batch with one value of a column."""
    v = batch.column(name).to_numpy()
    cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def in_blocks(docs: DataFrame) -> DataFrame:
    """The rows in as few tasks as blocks need, though one for each core where there are so many."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return docs.coalesce(max(1 + total // BLOCK_BYTES, docs.sparkSession.sparkContext.defaultParallelism))


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Log10 probability of every text under the trie of the texts that aren't held out, and under a model of single words.

    docs: doc_id, text; further columns are left out. held_out: a condition on docs; null counts as false. Returns RESULT and
    train_tokens. score is of the text as it is, byte by byte, and of its end. base_score is of its words with A-Z in lower
    case and of one end: log10((c + 0.5) / (N + 0.5 (V + 1))) each, c being the word's count and N all, V distinct of the
    training words and ends. Null texts count as empty and have an end; repeated rows get equal rows; with nothing to learn
    from, every symbol has 1/256 and every word 1; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    folder = new_folder(spark, "partial-matching")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    notes = kept(note(in_blocks(rows)), "notes")
    keys, bundles = notes.where(F.col("kind") != DOCS).select("block", "kind", "key", "n"), notes.where(F.col("kind") == DOCS)
    counts = kept(keys.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    of_words = counts.where(F.col("kind") == WORD)
    found = of_words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    ends = bundles.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, kinds = found["n"] + ends, found["v"] + (ends > 0)
    values = log_probabilities(counts.where(F.col("kind") == GRAM)).select(F.lit(GRAM).alias("kind"), "key", "value")
    values = values.unionByName(of_words.select("kind", "key", F.log10(F.col("n") + 0.5).alias("value")))
    back = keys.select("block", "kind", "key").join(values, ["kind", "key"]).select("block", "kind", "key", "value")
    both = back.unionByName(bundles.select("block", "kind", "docs"), allowMissingColumns=True)
    turn = (F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF)) % shuffle_parts(spark)
    dealt = both.repartitionById(shuffle_parts(spark), turn.cast("int")).sortWithinPartitions("block", F.col("kind").desc())
    out = scored(dealt, log10(ends + 0.5), int(ends > 0), log10(total + 0.5 * (kinds + 1)))
    path = new_folder(spark, "partial-matching-scores")
    out.withColumn("train_tokens", F.lit(total).cast("long")).write.parquet(path)
    removed(spark, folder)
    return spark.read.parquet(path)


class Adaptive:
    """The same prediction by a trie that learns from each symbol after it was coded."""

    def __init__(self, order: int = ORDER) -> None:
        self.order, self.nodes = order, defaultdict(Counter)

    def code(self, data: bytes, learn: bool = True) -> float:
        """Log10 probability of a text and its end, which the trie learns."""
        context, parts = bytes([END]) * self.order, []
        for symbol in data + bytes([END]):
            contexts = [context[self.order - k :] for k in range(self.order, -1, -1)]
            excluded: set[int] = set()
            for c in contexts:
                node = self.nodes.get(c)
                if node:
                    counts = {s: n for s, n in node.items() if s not in excluded}
                    n = sum(counts.values())
                    if symbol in counts:
                        parts.append(log10((2 * counts[symbol] - 1) / (2 * n)))
                        break
                    if counts:
                        parts.append(log10(len(counts) / (2 * n)))
                    excluded |= node.keys()
            else:
                parts.append(-log10(SYMBOLS - len(excluded)))
            for c in contexts if learn else []:  # a shorter context learns a symbol only where the longer one hadn't seen it
                node = self.nodes[c]
                node[symbol] += 1
                if node[symbol] > 1:
                    break
            context = context[1:] + bytes([symbol]) if self.order else b""
        return fsum(parts)


def adaptive(docs: DataFrame) -> DataFrame:
    """Log10 probability of every text under a trie that begins empty and learns from the text itself: doc_id, score.

    Text by text in the task that has it, in time and memory that grow with the text. Null texts count as empty.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [Adaptive().code((t or "").encode()) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select("doc_id", "text"), rows, "doc_id long, score double")
