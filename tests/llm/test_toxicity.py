import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from galleria.llm import toxicity as T


def made_up(n, seed=3):
    rng = np.random.default_rng(seed)
    common = [f"word{i}" for i in range(200)]
    texts, labels = [], []
    for _ in range(n):
        found = [" ".join(rng.choice(common, 8)) for _ in range(rng.integers(1, 8))]
        bad = rng.random() < 0.25
        if bad:
            at = rng.integers(0, len(found))
            found[at] += " " + rng.choice(["grumpy", "nastylike"])
        texts.append(". ".join(found) + ".")
        labels.append(int(bad))
    return texts, labels


def test_learns_which_sentence_offends(spark):
    texts, labels = made_up(1200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, y in enumerate(labels)]) > 0.98
    # The sentence that holds the word is located in nearly all toxic documents, and no other one.
    right = [[p.place for p in got[i].offending] == [k for k, x in enumerate(texts[i].split(".")) if "grumpy" in x or "nastylike" in x] for i, y in enumerate(labels) if y]
    assert np.mean(right) > 0.95
    one = spark.createDataFrame([(1, "nice words here. grumpy thing there. word1 word2.")], "doc_id long, text string")
    assert [(r.place, r.sentence.strip()) for r in T.offending_sentences(one, model).collect()] == [(1, "grumpy thing there")]
    assert [p.place for p in T.score(one, model).first().offending] == [1]


def plain_loss(theta, docs, labels):
    """Negative mean log-likelihood by loops: docs are lists of sentences, these lists of feature numbers."""
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    total, k = 0.0, len(theta) - 2
    for sentences, y in zip(docs, labels, strict=True):
        clean = 1 - sigmoid(theta[k + 1])
        for s in sentences:
            clean *= 1 - sigmoid(theta[k] + sum(theta[c] for c in s))
        total -= math.log(1 - clean) if y else math.log(clean)
    return total / len(docs) + 0.5 * T.PENALTY * sum(x * x for x in theta[:k])


def test_loss_and_gradient_against_plain_loops():
    rng = np.random.default_rng(6)
    docs = [[sorted(rng.choice(9, rng.integers(1, 4), replace=False).tolist()) for _ in range(rng.integers(0, 5))] for _ in range(40)]
    labels = rng.integers(0, 2, 40)
    sents = [(d, s) for d, ss in enumerate(docs) for s in ss]
    bags = T.Bags(np.array([d for d, _ in sents]), np.repeat(np.arange(len(sents)), [len(s) for _, s in sents]), np.array([c for _, s in sents for c in s]), labels)
    for _ in range(3):
        theta = rng.normal(0, 1, 11)
        loss, grad = T.objective(theta, bags)
        assert abs(loss - plain_loss(theta, docs, labels)) < 1e-9
        for i in range(11):
            step = np.zeros(11)
            step[i] = 1e-6
            assert abs(grad[i] - (plain_loss(theta + step, docs, labels) - plain_loss(theta - step, docs, labels)) / 2e-6) < 1e-6


def plain_score(model, text):
    """Noisy-or by the definition: every sentence with a known word may offend, and so may what is there without any."""
    clean = math.exp(model.rest)
    found = []
    place = 0
    for s in re.split("[.!?;\n]", text.lower()):
        if not s.strip():
            continue
        words = set(re.findall(r"\w+", s))
        known = [w for w in model.weights if (w[:-1] in {x[: len(w) - 1] for x in words if len(x) > len(w) - 1} and len(w) - 1 in T.BEGINNINGS if w.endswith("*") else w in words)]
        if known:
            p = 1 / (1 + math.exp(-(model.bias + sum(model.weights[w] for w in known))))
            clean *= 1 - p
            if p >= T.THRESHOLD:
                found.append(place)
        place += 1
    return 1 - clean, found


def plain_words(texts, labels):
    """The chosen features by counting."""
    share, seen, toxic = sum(labels) / len(labels), Counter(), Counter()
    for t, y in zip(texts, labels, strict=True):
        words = set(re.findall(r"\w+", t.lower()))
        every = words | {w[:n] + "*" for w in words for n in T.BEGINNINGS if len(w) > n}
        seen.update(every)
        toxic.update(every if y else ())
    z = {w: (toxic[w] - n * share) / math.sqrt(n * share * (1 - share) + 1e-9) for w, n in seen.items() if n >= T.LEAST_DOCS}
    return sorted((w for w in z if z[w] >= T.LEAST_EXCESS), key=lambda w: (-z[w], w))[: T.MOST_FEATURES]


def test_scores_against_plain_loops(spark, sf, awkward):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = T.train(docs, labels)
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    marks = {r.doc_id: r.toxic for r in labels.collect() if not held(r.doc_id)}
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    known = [(t, marks[d]) for d, t in rows if d in marks]
    assert set(model.weights) == set(plain_words([t for t, _ in known], [y for _, y in known]))
    rows += [(r.doc_id, r.text or "") for r in awkward.where("doc_id > 2000000 OR length(text) < 10000").collect()]
    got = [(r.doc_id, round(r.score, 6), [p.place for p in r.offending]) for frame in (docs, awkward.where("doc_id > 2000000 OR length(text) < 10000")) for r in T.score(frame, model).collect()]
    want = [(d, round((x := plain_score(model, t))[0], 6), x[1]) for d, t in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_held_out_accuracy(spark):
    """On the table of sf0.1: rows with labels that aren't learned from."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = T.score(docs, T.train(docs, labels))
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    hit = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert hit / max(1, rows.predicted.sum()) > 0.9 and hit / rows.toxic.sum() > 0.9
    assert rows.score.between(0, 1).all()


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(T.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert T.train(docs, labels) == T.train(docs, flipped)
    for r in T.score(docs, T.train(docs, labels)).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_awkward_rows(spark, sf, awkward, nothing):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = T.train(docs, labels)
    out = T.score(awkward, model).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= T.THRESHOLD) for r in out)
    assert T.keep_clean(awkward, model).columns == awkward.columns
    assert T.score(nothing, model).count() == 0 and T.keep_clean(nothing, model).count() == 0
    none = T.train(nothing.select("doc_id", "text"), labels.limit(0))
    assert T.score(awkward, none).count() == awkward.count()
    assert T.offending_sentences(awkward, model).columns == ["doc_id", "place", "sentence", "probability"]
