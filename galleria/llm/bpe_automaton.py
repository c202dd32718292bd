"""BPE encoding and decoding with a tokenization automaton.

The merges of a byte-level vocabulary are compiled into a deterministic automaton over tokens. It starts as one state
with a loop for each byte. A merge of u and v adds one gadget: the state that u leads to is copied without its v arc, all
u arcs are led to the copy, and an arc for uv is added wherever u can be read, to the state that v led to. The paths of
the finished automaton are exactly the token sequences that the merge rules produce, so each word has exactly one path.

A state has tens of thousands of arcs, so they are not stored one by one: a state is kept as the difference to the one it
was copied from (the arc it lost, and when). The states form a tree, and "has this state lost that arc" is an interval
test in it.

Words are encoded with two tables. One is followed byte by byte: its states are the beginnings of labels, and each state
tells which labels end there. The other holds the arcs that have been looked up, token to token. Every prefix of a word has
one path, so at each byte exactly one label goes on from the path so far, and a word is one walk from left to right.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from galleria.llm.common import map_batches, texts_of



def _class(kinds: str) -> str:
    """Characters below U+0530 of the Unicode categories that begin with one of the letters, as a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x530) if unicodedata.category(chr(c))[0] in kinds)


#: The pattern that splits texts before byte-level merges, for characters that every version of Unicode classes alike;
#: texts with others (OTHERS) are split by the tokenizers library's own splitter.
LETTER, NUMBER, SPACE = _class("L"), _class("N"), r"\t-\r \x85\xa0"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SPLIT_ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\\sA-Za-z0-9]+|\\s+(?!\\S)|\\s+", re.ASCII)
OTHERS = re.compile("[^\u0000-\u052f\u2010-\u2027\u2030-\u205e\u20ac]")
SPLITTER = pre_tokenizers.ByteLevel(add_prefix_space=False)


def split_words(text: str) -> list[str]:
    """The pieces of a text within which merges apply."""
    if text.isascii():
        return SPLIT_ASCII.findall(text)
    if OTHERS.search(text) is None:
        return SPLIT.findall(text)
    return [text[a:b] for _, (a, b) in SPLITTER.pre_tokenize_str(text)]


#: Entries kept of a worker's tables of words and of arcs; a full table starts anew.
WORDS_KEPT, ARCS_KEPT = 200_000, 300_000
ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, as character -> byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """Deterministic automaton over the tokens of one vocabulary; `encode_word` and `decode` use it."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        byte_of = byte_alphabet()
        self.added = added
        self.labels: dict[int, bytes] = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.labels |= {i: token.encode() for token, i in added.items()}
        self.ids = {self.labels[i]: i for i in vocab.values()}
        # States: 0 is the first; state k > 0 is a copy of source[k] that lost an arc in merge k.
        source, born = [0], [-1]
        leads_to: dict[int, int] = {self.ids[bytes([b])]: 0 for b in range(256) if bytes([b]) in self.ids}
        self.made: dict[int, int] = dict.fromkeys(leads_to, -1)  # token -> merge that made it
        self.parts: dict[int, tuple[int, int]] = {}
        self.lost: dict[int, int] = {}  # u and v -> the copy whose v arc went
        for k, (left, right) in enumerate(merges):
            u, v, uv = vocab[left], vocab[right], vocab[left + right]
            if uv in self.made or u not in leads_to or v not in leads_to:
                raise ValueError(f"merge {k} ({left} {right}) makes a token again, or of one that no merge before it makes")
            state, after = leads_to[u], leads_to[v]
            source.append(state)
            born.append(k)
            copy = len(source) - 1
            self.lost[u << 32 | v] = copy
            leads_to[u] = copy
            leads_to[uv] = after
            self.made[uv], self.parts[uv] = k, (u, v)
        self.leads_to, self.born = leads_to, born
        self.enter, self.leave = self._intervals(source)
        self.arcs: dict[int, bool] = {}
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        # A merge of tokens that no path has side by side, as earlier merges come first, never applies.
        never: set[int] = set()
        for uv, (u, v) in self.parts.items():
            copy = self.lost[u << 32 | v]
            if u in never or v in never or not self._reads(self.enter[source[copy]], u, v, born[copy]):
                never.add(uv)
        # Goto and failure tables over the bytes of all labels that paths can have.
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token in self.made.keys() - never:
            label = self.labels[token]
            self.matcher.add_word(label.decode("latin-1"), token)
        self.matcher.make_automaton()
        self.lengths = {i: len(label) for i, label in self.labels.items()}
        self.four = {i: i.to_bytes(4, "little") for i in self.labels}
        self.words: dict[str, bytes] = {}
        self._added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    @staticmethod
    def from_json(data: bytes) -> Automaton:
        """From the JSON file of a byte-level tokenizer; raises on settings that change what is encoded."""
        t = json.loads(data)
        model, split, added = t["model"], t.get("pre_tokenizer") or {}, t.get("added_tokens") or []
        wrong = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        wrong += [k for k in ("normalizer", "post_processor") if t.get(k)]
        wrong += [] if model.get("type", "BPE") == "BPE" else ["model"]
        wrong += [] if split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) else ["pre_tokenizer"]
        wrong += [] if (t.get("decoder") or {}).get("type") == "ByteLevel" else ["decoder"]
        wrong += [a["content"] for a in added if a.get("single_word") or a.get("lstrip") or a.get("rstrip") or a.get("normalized")]
        if wrong:
            raise ValueError(f"settings of the tokenizer that are not supported: {', '.join(wrong)}")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in t["model"]["merges"]]
        special = {a["content"]: a["id"] for a in added}
        return Automaton({k: v for k, v in model["vocab"].items() if k not in special}, merges, special)

    @staticmethod
    def _intervals(source: list[int]) -> tuple[list[int], list[int]]:
        """Enter and leave times of a walk over the tree of states: a is above b if its interval holds b's."""
        n = len(source)
        size = [1] * n
        for k in range(n - 1, 0, -1):  # a copy comes after its source
            size[source[k]] += size[k]
        enter, free = [0] * n, [1] * n
        for k in range(1, n):
            enter[k] = free[source[k]]
            free[source[k]] += size[k]
            free[k] = enter[k] + 1
        return enter, [enter[k] + size[k] for k in range(n)]

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and what it begins (side 0) or ends (side 1) with, each with the merge that took it up."""
        if (got := self._spines.get((token, side))) is None:
            got, until = [], 1 << 60
            while True:
                got.append((token, until))
                if token not in self.parts:
                    break
                until, token = self.made[token], self.parts[token][side]
            self._spines[got[0][0], side] = got
        return got

    def _reads(self, at: int, last: int, token: int, before: int = 1 << 60) -> bool:
        """Whether a state that `last` leads to (by its enter time) has an arc for `token` after the merges before one."""
        for ending, _ in self._spine(last, 1):
            for beginning, taken in self._spine(token, 0):
                copy = self.lost.get(ending << 32 | beginning)
                if copy is not None and self.born[copy] < before and self.born[copy] <= taken and self.enter[copy] <= at < self.leave[copy]:
                    return False
        return True

    def has_arc(self, last: int, token: int) -> bool:
        """Whether the state that `last` leads to has an arc for `token`."""
        key = last << 32 | token
        if (known := self.arcs.get(key)) is None:
            known = self._reads(self.enter[self.leads_to[last]], last, token)
            if len(self.arcs) >= ARCS_KEPT:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """The one path that spells the word.

        The matcher is followed byte by byte and tells which labels end there. Every prefix of the word has one path, so one
        of these labels has an arc from the token before it; it is the last token of the path so far. Nothing is taken
        back: when the word ends, its tokens are read off from the last to the first.
        """
        arcs, lengths, last, done = self.arcs, self.lengths, [-1] * (len(word) + 1), -1
        for end, token in self.matcher.iter(word.decode("latin-1")):
            if end == done:
                continue
            before = last[end + 1 - lengths[token]]
            if before < 0 or (arcs[k] if (k := before << 32 | token) in arcs else self.has_arc(before, token)):
                last[end + 1], done = token, end
        path, at = [], len(word)
        while at:
            token = last[at]
            if token < 0:
                raise ValueError(f"no path spells {word!r}")
            path.append(token)
            at -= lengths[token]
        path.reverse()
        return path

    def encode(self, text: str) -> bytes:
        """Token ids of a whole text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        if self._added:
            for m in self._added.finditer(text):
                out += [self._plain(text[at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
                at = m.end()
        return b"".join([*out, self._plain(text[at:] if at else text)])

    def _plain(self, text: str) -> bytes:
        words = self.words
        pieces = split_words(text)
        try:
            return b"".join([words[w] for w in pieces])
        except KeyError:
            pass
        got, four = [], self.four
        for w in pieces:
            if (ids := words.get(w)) is None:
                ids = np.array(path, "<u4").tobytes() if len(path := self.encode_word(w.encode())) > 8 else b"".join([four[t] for t in path])
                if len(w) <= 64:
                    if len(words) >= WORDS_KEPT:
                        words.clear()
                    words[w] = ids
            got.append(ids)
        return b"".join(got)

    def decode(self, ids: bytes) -> str:
        """The text that the labels of a path spell, with the replacement character for broken UTF-8."""
        labels = self.labels
        return b"".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_compiled: dict[str, Automaton] = {}


def compiled(data: bytes) -> Automaton:
    """The automaton of a tokenizer file, compiled once in each worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _compiled:
        _compiled[key] = Automaton.from_json(data)
        gc.freeze()  # the tables stay: the garbage collector need not walk them again and again
    return _compiled[key]


def encode_decode(docs: DataFrame, tokenizer_path: str, with_digests: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    docs: doc_id, text and any further columns (left out of the result). Returns ENCODED: doc_id, n_tokens, ids (binary,
    little-endian unsigned 32-bit integers) and decoded; with_digests: doc_id, n_tokens, ids_sha256, decoded_sha256
    in place of the last two. The tokenizer's file is read on the driver and sent to the workers (its size is that of a
    vocabulary, not of the data).

    A null text counts as empty: no tokens, decoded to the empty text. Rows are mapped one by one: an empty table gives
    an empty result, repeated rows and null doc_ids are kept as they are, texts may have any length.
    """
    with open(tokenizer_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = compiled(sent.value)
        ids = [automaton.encode(t) for t in texts_of(batch)]
        decoded = [automaton.decode(x) for x in ids]
        n = pa.array([len(x) // 4 for x in ids], pa.int64())
        if with_digests:
            a = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
            b = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), n, a, b], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if with_digests else ENCODED
    return map_batches(docs.select("doc_id", "text"), rows, schema)
