import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from galleria.llm import substrings as U
from galleria.llm.chunks import boundaries, code_points, scrambled


def cut_text(t):
    """Ends of chunks by the definition: at each place the gear hash of the last 32 characters, one after the other."""
    points = [ord(c) for c in t]
    gear = (scrambled(np.array(points, np.uint64)) >> np.uint64(32)).tolist() if points else []
    bits, ends, start, h = U.SIZES.normal.bit_length() - 1, [], 0, 0
    for i in range(len(points)):
        h = ((h << 1) + gear[i]) % (1 << 32)
        size = i + 1 - start
        limit = 1 << (32 - bits - 1) if size < U.SIZES.normal else 1 << (32 - bits + 1)
        left = len(points) - start
        if left > U.SIZES.least and size >= U.SIZES.least and (h < limit or size == U.SIZES.most):
            ends.append(i + 1)
            start = i + 1
    return ends + [len(points)] * (start < len(points))


def by_brute_force(texts, least):
    """Longest passage of each text, by plain loops."""
    cut = {}
    for t in set(texts):
        ends = cut_text(t)
        cut[t] = [(a, t[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    where = Counter(c for chunks in cut.values() for c in {c for _, c in chunks})
    runs = {}
    for t, chunks in cut.items():
        found = []
        for a, c in [*chunks, (0, None)]:
            if where[c] > 1:
                found.append((a, c))
                continue
            if (n := sum(min(U.WORDS, len(c.split())) for _, c in found)) >= min(U.RUN_WORDS, least):
                runs.setdefault(t, []).append((n, found))
            found = []
    doubtful = {c for found in runs.values() for n, run in found if n < least for _, c in run}
    windows, owners = {}, {}
    for t, found in runs.items():
        words = [(m.start(), m[0]) for m in re.finditer(r"\S+", t)]
        for k, (_, run) in enumerate(found):
            own = windows[t, k] = set()
            for a, c in run:
                if c in doubtful:
                    at = next((i for i, (x, _) in enumerate(words) if x >= a), len(words))
                    own |= {tuple(w for _, w in words[i : i + least]) for i in range(max(0, at - least + 1), at + 1) if i + least <= len(words)}
            for w in own:
                owners.setdefault(w, set()).add(t)
    copies, out = Counter(texts), []
    for t in texts:
        kept = [n for k, (n, _) in enumerate(runs.get(t, ())) if n >= least or any(len(owners[w]) > 1 for w in windows[t, k])]
        best = len(t.split()) if copies[t] > 1 and len(t.split()) >= least else max(kept, default=None)
        out.append(best)
    return out


def test_boundaries_by_their_definition():
    rng = np.random.default_rng(2)
    for n in (0, 1, 15, 16, 17, 33, 500, 4000):
        t = "".join(chr(c) for c in rng.choice([97, 98, 99, 32, 233, 0x6F22, 0x1F600], n))
        assert boundaries(code_points(t), U.SIZES) == cut_text(t)


def test_against_brute_force(spark, sf, awkward, nothing):
    for frame in (spark.read.parquet(f"{sf}/documents.parquet"), awkward):
        rows = [(r.doc_id, r.text or "") for r in frame.collect()]
        out = U.repeated_passages(frame).collect()
        got = sorted(((r.doc_id is not None, r.doc_id or 0, r.longest) for r in out))
        want = sorted((d is not None, d or 0, x) for (d, _), x in zip(rows, by_brute_force([t for _, t in rows], U.LEAST_WORDS), strict=True) if x)
        assert got == want
        kept = {(r.doc_id, len(r.text or ""), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in U.dedup(frame).collect()}
        assert {(r.doc_id, r.kept_chars, r.kept_sha256) for r in out} <= kept
    assert U.repeated_passages(nothing).count() == 0


def test_passage_in_other_surroundings(spark):
    passage = " ".join(f"p{i * 7919 % 1000}" for i in range(60))
    own = [" ".join(f"{k}{i * 31 % 500}" for i in range(80)) for k in "abcd"]
    rows = [(0, own[0] + " " + passage + " " + own[1], 1), (1, own[2] + "! " + passage + own[3], 1), (2, " ".join(f"z{i}" for i in range(200)), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int")
    assert sorted(r.doc_id for r in U.repeated_passages(docs).collect()) == [0, 1]
    kept = {r.doc_id: r.text for r in U.dedup(docs).collect()}
    assert kept[0] == rows[0][1] and kept[2] == rows[2][1]
    assert len(kept[1]) < len(rows[1][1]) - len(passage) // 2 and kept[1].startswith(own[2])


def test_dedup_keeps_columns(awkward, nothing):
    out = U.dedup(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert U.dedup(nothing).count() == 0
    assert xxhash.xxh3_64_intdigest(b"") >= 0


def test_repeats_below_fifty_words_do_not_count(spark):
    rng = np.random.default_rng(9)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    short, long = [word(40) for _ in range(40)], [word(55) for _ in range(40)]
    rows = [f"{word(60)} {p} {word(60)}" for p in [*short, *short, *long, *long]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id for r in U.repeated_passages(docs).collect()}
    assert not got & set(range(80)) and len(got) >= 78


def test_tables_that_are_not_broadcast(spark, sf, monkeypatch):
    from galleria.llm import common

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(str, U.repeated_passages(docs).collect()))
    monkeypatch.setattr(common, "SMALL", -1)
    assert sorted(map(str, U.repeated_passages(docs).collect())) == want


@pytest.mark.parametrize("letters", [2, 3, 5, 9])
def test_planted_passages_of_short_and_long_words(spark, letters):
    """Passages of 52 words, each in two texts of other words. Very short words make passages that are hardly longer than a
    chunk, and not all of these have one of their own in both texts: the shares are measured."""
    rng = random.Random(letters)
    some = lambda n, size: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)) for _ in range(n))
    rows = []
    for i in range(60):
        passage = some(52, letters)
        rows += [(2 * i + k, f"{some(rng.randrange(5, 60), 7)} {passage} {some(rng.randrange(5, 60), 7)}") for k in (0, 1)]
    rows += [(1000 + i, some(120, letters)) for i in range(60)]
    found = {r.doc_id for r in U.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(d >= 1000 for d in found) and len(found) >= {2: 0.85, 3: 0.95}.get(letters, 0.99) * 120, len(found)


@pytest.mark.parametrize("least", [3, 12, 50])
def test_window_hashes(least):
    rng = random.Random(least)
    words = [rng.choice(["a", "bb", "é", "漢字", "😀x"]) for _ in range(90)]
    each = [w.encode() for w in words]
    ends = np.cumsum([0, *(len(w) + 1 for w in each)]).tolist()
    got = U.hashed(b" ".join(each), ends, least, range(len(words) - least + 1)).tolist()
    assert got == [xxhash.xxh3_64_intdigest(" ".join(words[i : i + least]).encode()) - (1 << 63) for i in range(len(words) - least + 1)]


@pytest.mark.parametrize("least", [7, 50])
def test_words_of_many_bytes_and_odd_spaces(spark, least):
    """Passages that are just long enough, apart from each other by spaces only, as a plain loop finds them."""
    rng = random.Random(least)
    word = lambda: "".join(rng.choice("abé漢😀") for _ in range(rng.randint(2, 9)))
    texts = []
    for _ in range(12):
        passage = [word() for _ in range(rng.choice([least - 1, least, least + 30]))]
        for _ in range(2):
            parts = [word() for _ in range(60)] + passage + [word() for _ in range(60)]
            texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "  "]) for w in parts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.longest for r in U.repeated_passages(frame, least).collect()}
    assert got == {i: x for i, x in enumerate(by_brute_force(texts, least)) if x}
