"""Partial matching against a trie that learns text by text, sums of probabilities, held-out likelihood."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from galleria.llm import matching
from galleria.llm.matching import END, ORDER, Adaptive, Trie, grams, portions, words
from galleria.llm.queries import QUERIES


def held():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def brute(rows):
    """Scores of (doc_id, text) by a dictionary trie and a word count."""
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    trie, words, ends = Adaptive(), Counter(), 0
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            trie.code((t or "").encode())
            words.update((t or "").encode().lower().split())
            ends += 1
    n, v, out = sum(words.values()) + ends, len(words) + (ends > 0), []
    p = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    for (d, t), h in zip(rows, held, strict=True):
        found = [words[w] for w in (t or "").encode().lower().split()] + [ends]
        out.append((d, h, len(found), sum(c > 0 for c in found), round(sum(map(p, found)), 6), round(trie.code((t or "").encode(), learn=False), 6), n))
    return out


def rounded(df):
    rows = df.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "train_tokens").collect()
    return [(*r[:4], round(r[4], 6), round(r[5], 6), r[6]) for r in rows]


def key(r):
    return (r[0] is None, r[0] or 0, r[4], r[5])


def test_awkward_rows_like_a_dictionary_trie(spark, awkward, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_BYTES", 3000)  # several blocks a task
    monkeypatch.setattr(matching, "UNMERGED", 500)
    monkeypatch.setattr(matching, "PIECE", 700)  # long texts in several parts
    some = awkward.where("coalesce(length(text), 0) < 100000").repartition(3)
    want = brute([(r["doc_id"], r["text"]) for r in some.collect()])
    assert sorted(rounded(matching.score(some, held())), key=key) == sorted(want, key=key)


def test_real_documents_like_a_dictionary_trie(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(rounded(matching.score(df, held())), key=key) == sorted(brute(rows), key=key)


def test_symbols_after_a_context_sum_to_one():
    texts = [b"the cat sat on the mat", b"the hat", "été à la mer".encode(), b"", b"aaaaaaa"]
    keys, n = np.unique(np.concatenate([grams(p)[0] for p in portions(texts)]), return_counts=True)
    trigrams = np.unique(keys & 0xFFFFFF)
    pairs = np.unique(trigrams & 0xFFFF, return_counts=True)
    trie = Trie(keys, n, [pairs, np.unique(pairs[0] & 0xFF, return_counts=True)])
    for context in (b"\xff" * ORDER, b"n the", b"the q", b"zzzzz", b"aaaaa", b"zz th"):
        start = int.from_bytes(context, "big") << 8
        assert abs(sum(10.0 ** trie.log10(start + np.arange(256))) - 1) < 1e-9


@pytest.mark.parametrize("piece", [1, 3, 4, 1000])
def test_grams_and_words_of_parts(piece, monkeypatch):
    monkeypatch.setattr(matching, "PIECE", piece)
    texts = [b"ab cd", b"", b"c\x0b AB", b"  ", b"abcdefgh", "é ab\u00a0cd".encode()]
    got, found = [], []
    for p in portions(texts):
        got += zip(*(x.tolist() for x in grams(p)), strict=True)
        found += zip(*(x.tolist() for x in words(p)), strict=True)
    want = []
    for i, t in enumerate(texts):
        padded = bytes([END]) * ORDER + t + bytes([END])
        want += [(int.from_bytes(padded[j : j + ORDER + 1], "big"), i) for j in range(len(t) + 1)]
    assert got == want
    plain = [(w, i) for i, t in enumerate(texts) for w in t.lower().split()]
    assert [i for _, i in found] == [i for _, i in plain]
    assert len(set(zip(plain, found, strict=True))) == len(set(plain)) == len({h for h, _ in found} | set()) + 1  # "ab" is in two texts


def test_different_words_have_different_hashes():
    many = [f"{a}{b}".encode() for a in range(300) for b in "abcdefghijé"]
    h, _ = words([(0, b"", b" ".join(many), b"")])
    assert len(set(h.tolist())) == len(set(many))


def test_nothing_to_learn_and_no_rows(spark, nothing):
    assert matching.score(nothing, held()).count() == 0
    one = spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id long, text string")
    got = sorted(rounded(matching.score(one, F.lit(True))))
    assert got == [(1, True, 3, 0, 0.0, round(-5 * math.log10(256), 6), 0), (2, True, 1, 0, 0.0, round(-math.log10(256), 6), 0)]


def test_long_texts_ties_and_clashing_columns(spark, awkward):
    got = matching.score(awkward.withColumn("a.b", F.lit(1)).withColumn("gram", F.lit("x")), held())
    assert got.count() == awkward.count() and got.where("score > 0 OR base_score > 0 OR isnan(score)").count() == 0


def test_adaptive_code_lengths(spark):
    df = spark.createDataFrame([(1, "abab" * 50), (2, "xq"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in matching.adaptive(df).collect()}
    assert -got[1] < 201 * math.log10(256) / 10 and abs(got[3] + math.log10(256)) < 1e-12


def test_the_query_beats_single_words_on_held_out_documents(spark, sf):
    got = QUERIES["op11_partial_matching"](spark, sf.replace("0.001", "0.01"))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "train_tokens"]
    bits = got.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got.count() == 1000 and bits[0] > 1.25 * bits[1]
