import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from galleria.llm import bpe_automaton as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def automaton():
    with open(PATH, "rb") as f:
        return B.compiled(f.read())


def test_small_merges_by_hand():
    vocab = {c: i for i, c in enumerate(B.byte_alphabet())}
    for merge in ("ab", "aa", "aab", "ba"):
        vocab[merge] = len(vocab)
    a = B.Automaton(vocab, [("a", "b"), ("a", "a"), ("a", "ab"), ("b", "a")], {})
    spell = lambda w: [a.labels[t].decode() for t in a.encode_word(w.encode())]
    assert spell("aab") == ["aab"]
    assert spell("aaa") == ["aa", "a"]
    assert spell("aaab") == ["aa", "ab"] or spell("aaab") == ["a", "aab"]
    assert spell("bab") == ["b", "ab"]


def test_same_ids_as_the_library(automaton, library):
    random.seed(5)
    pool = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for _ in range(3000):
        s = "".join(random.choice(pool) if random.random() < 0.2 else random.choice(" \n\t'abestrdm1A.\x85\xa0\x1c<|>É") for _ in range(random.randint(0, 60)))
        if random.random() < 0.1:
            s += "<|endoftext|>" + s[:4]
        ids = library.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(automaton.encode(s), "<u4").tolist() == ids
        assert automaton.decode(automaton.encode(s)) == library.decode(ids, skip_special_tokens=False)


def test_query_against_the_library(spark, sf, library):
    import __spark_entry__

    got = {r.doc_id: r for r in __spark_entry__.queries()["op4_bpe_automaton"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_rows(awkward, nothing):
    out = B.encode_decode(awkward, PATH).collect()
    assert len(out) == awkward.count()
    want = sorted((x or "") for (x,) in awkward.select("text").collect())
    assert sorted(r.decoded for r in out) == want
    assert B.encode_decode(nothing, PATH).count() == 0


def plain_bpe(word, merges):
    """Merges by rank until none applies."""
    parts, rank = list(word), {m: i for i, m in enumerate(merges)}
    while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]:
        first = parts[min(pairs)[1]], parts[min(pairs)[1] + 1]
        out, i = [], 0
        while i < len(parts):
            if tuple(parts[i : i + 2]) == first:
                out.append("".join(first))
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def test_random_merges_against_plain_bpe(monkeypatch):
    """Also words that equal a token which their merges don't make, and tables that start anew in the middle of a word."""
    rng = random.Random(8)
    monkeypatch.setattr(B, "ARCS_KEPT", 40)
    for _ in range(150):
        tokens, merges = list("abc"), []
        for _ in range(rng.randrange(1, 14)):
            m = rng.choice(tokens), rng.choice(tokens)
            if "".join(m) not in tokens:
                tokens.append("".join(m))
                merges.append(m)
        vocab = {c: i for i, c in enumerate([*B.byte_alphabet(), *tokens[3:]])}
        a = B.Automaton(vocab, merges, {})
        for word in [*tokens, *("".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(40))]:
            assert [a.labels[t].decode() for t in a.encode_word(word.encode())] == plain_bpe(word, merges)


def test_what_is_not_supported_raises():
    vocab = {c: i for i, c in enumerate([*B.byte_alphabet(), "ab", "abc", "bc"])}
    with pytest.raises(ValueError, match="again"):
        B.Automaton(vocab, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], {})
    with pytest.raises(ValueError, match="no merge before"):
        B.Automaton(vocab, [("ab", "c")], {})
    import json

    with open(PATH) as f:
        good = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": good["model"] | {"ignore_merges": True}}, {"added_tokens": [good["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError, match="not supported"):
            B.Automaton.from_json(json.dumps(good | change).encode())
