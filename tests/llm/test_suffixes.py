import re

import numpy as np

from galleria.llm import suffixes as X

WORD = re.compile(r"[^\x00-\x20]+")


def repeated_words(texts):
    """Words of each text that lie in a window of LEAST words which stands in another, different text (or a copy)."""
    cut = {t: WORD.findall(t) for t in set(texts)}
    where = {}
    for t, w in cut.items():
        for i in range(len(w) - X.LEAST + 1):
            where.setdefault(tuple(w[i : i + X.LEAST]), set()).add(t)
    found = []
    for t in texts:
        w = cut[t]
        if texts.count(t) > 1 and len(w) >= X.LEAST:
            found.append(set(range(len(w))))
            continue
        hit = set()
        for i in range(len(w) - X.LEAST + 1):
            if len(where[tuple(w[i : i + X.LEAST])]) > 1:
                hit.update(range(i, i + X.LEAST))
        found.append(hit)
    return found


def test_hashes():
    text = "  a bc\tdéf \n a bc x"
    words = X.word_hashes(text)
    assert len(words) == 6 and words[0] == words[3] and words[1] == words[4] and len(set(words.tolist())) == 4
    pairs = X.runs_hashed(words, 2)
    assert pairs[0] == pairs[3] and len(set(pairs.tolist())) == 4


def test_every_repeat_holds_a_common_minimiser():
    rng = np.random.default_rng(4)
    passage = rng.integers(1, 2**63, X.LEAST).astype(np.uint64)
    for _ in range(50):
        kept = []
        for _ in range(2):
            left = rng.integers(1, 2**63, rng.integers(0, 60)).astype(np.uint64)
            at = X.minimisers(np.concatenate([left, passage, rng.integers(1, 2**63, 40).astype(np.uint64)])) - len(left)
            kept.append({int(x) for x in at if 0 <= x <= X.LEAST - X.PREFIX})
        assert kept[0] & kept[1]


def test_against_brute_force(spark, sf, awkward, nothing):
    for frame in (spark.read.parquet(f"{sf}/documents.parquet"), awkward):
        rows = [(r.doc_id, r.text or "") for r in frame.collect()]
        want = sorted((d is not None, d or 0, len(hit)) for (d, _), hit in zip(rows, repeated_words([t for _, t in rows]), strict=True) if hit)
        out = X.repeated_passages(frame).collect()
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_repeated) for r in out)
        assert got == want
    assert X.repeated_passages(nothing).count() == 0


def words(rng, n, pool=10**6):
    return [f"w{x}" for x in rng.integers(0, pool, n)]


def check(spark, texts, parts=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: len(hit) for i, hit in enumerate(repeated_words(texts)) if hit}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts or before)
    try:
        assert {r.doc_id: r.n_repeated for r in X.repeated_passages(docs).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return want


def test_a_text_that_repeats_itself(spark):
    rng = np.random.default_rng(11)
    passage = words(rng, 60)
    one = sum(([*words(rng, 25), *passage] for _ in range(6)), [])
    assert check(spark, [" ".join(one), " ".join([*words(rng, 30), *passage, *words(rng, 30)])]) == {0: 360, 1: 60}


def test_matches_that_are_longest_on_neither_side(spark):
    rng = np.random.default_rng(12)
    passage = words(rng, 90)
    texts = [passage]
    for a in range(0, 40, 3):  # every text shares other parts of the passage
        texts.append([*words(rng, 20), *passage[a : a + 44 + a % 11], *words(rng, 20)])
    check(spark, [" ".join(t) for t in texts])


def test_hot_passages_over_many_partitions(spark):
    rng = np.random.default_rng(13)
    passage, other = words(rng, 70), words(rng, 55)
    texts = [" ".join([*words(rng, int(rng.integers(0, 30))), *passage[: int(rng.integers(45, 71))], *words(rng, int(rng.integers(0, 30)), 3), *other[int(rng.integers(0, 10)) :]]) for _ in range(300)]
    texts += [" ".join(["same"] * n) for n in (49, 50, 51, 400)] + [" ".join(["a", "b"] * n) for n in (24, 25, 90)]
    check(spark, texts, parts="23")


def test_random_texts_of_few_words(spark):
    rng = np.random.default_rng(14)
    pool = [words(rng, int(rng.integers(5, 60)), 40) for _ in range(12)]
    texts = [" ".join(sum((pool[k] for k in rng.integers(0, len(pool), 8)), [])) for _ in range(60)]
    check(spark, texts)
