"""Near-dedup against all pairs: the groups are those of every pair of texts with a likeness of 0.8 or more."""

import random

from pyspark.sql import functions as F

from galleria.llm import simhash as S


def by_brute_force(texts, least=0.8):
    """Ids that stay: the smallest of each component of all pairs."""
    sets, root = [S.shingle_set(t, 5) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= least * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in range(len(texts))})


def left(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in S.drop_near_duplicates(frame).collect())


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_links_that_a_forest_of_candidates_leaves_out(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [edited(rng, base, 4) for _ in range(250)]
    want = by_brute_force(texts)
    assert len(want) < 30
    assert left(spark, texts) == want


def test_equal_fingerprints_of_different_texts(spark):
    rng = random.Random(2)
    line = [f"banner{i}" for i in range(9)]
    texts = [" ".join(line * 60 + [f"w{rng.randrange(10**9)}" for _ in range(60)]) for _ in range(4)]
    assert len({S.simhash(t) for t in texts}) < 4
    assert max(S.similarity(a, b) for a in texts for b in texts if a != b) < 0.2
    assert left(spark, texts) == [0, 1, 2, 3]


def test_alike_texts_of_far_fingerprints(spark):
    rng, texts = random.Random(3), []
    for i in range(150):
        base = [f"w{i}v{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 300))]
        texts += [" ".join(base), edited(rng, base, rng.randrange(1, 2 + len(base) // 45))]
    pairs = [(a, b) for a, b in zip(texts[::2], texts[1::2], strict=True) if S.similarity(a, b) >= 0.8]
    assert sum((S.simhash(a) ^ S.simhash(b)).bit_count() > 6 for a, b in pairs) > 20
    assert left(spark, texts) == by_brute_force(texts)


def test_wordless_and_short_texts(spark):
    texts = ["", " \n ", "one", "One ", "one two three four five six", "one two three four five seven", "\t"]
    assert left(spark, texts) == [0, 2, 4, 5]


def test_recurring_shingles_are_told_among_many_texts(spark):
    """A shingle of 12 texts is known to be common whatever the number of texts: else its list counts as a rare one's."""
    n = 64_000
    shared = F.concat_ws(" ", *[F.concat(F.lit(w), F.expr("id div 12")) for w in "abcde"])
    own = F.concat_ws(" ", *[F.concat(F.lit(f"own{w}"), F.col("id")) for w in "abc"])
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", shared, own).alias("text"))
    keys, counts = S.common_keys(docs.withColumn("h", F.xxhash64("text")))
    want = [S.shingle_keys(" ".join(f"{w}{i}" for w in "abcde"))[0] for i in range(0, n // 12, 10)]
    assert sum(k in set(keys.tolist()) for k in map(int, want)) >= 0.9 * len(want)
    assert len(keys) <= n // 12 + 1 and counts.min() > 2


def test_cut_of_the_common_shingles_keeps_the_groups(spark, monkeypatch):
    rng = random.Random(4)
    lines = [" ".join(f"t{i}w{j}" for j in range(7)) for i in range(12)]
    texts = [" ".join([*rng.sample(lines, 5), *(f"w{rng.randrange(40)}" for _ in range(6))]) for _ in range(120)]
    texts += [edited(rng, t.split(), 1) for t in texts[::4]]
    want = by_brute_force(texts)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("h", F.xxhash64("text"))
    whole = dict(zip(*(x.tolist() for x in S.common_keys(frame)), strict=True))
    for most in (0, 20, 1 << 20):
        monkeypatch.setattr(S, "COMMON", most)
        keys, counts = S.common_keys(frame)
        assert len(keys) <= most and all(whole[k] == c for k, c in zip(keys.tolist(), counts.tolist(), strict=True))
        assert min(counts, default=1000) >= max([c for k, c in whole.items() if k not in set(keys.tolist())], default=0)
        assert left(spark, texts) == want
