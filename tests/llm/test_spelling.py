"""Spelling variants against all pairs of words and plain rules."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from galleria.llm import spelling
from galleria.llm.queries import QUERIES

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(a) + 1 == len(b) and a[i:] == b[i + 1 :])


def plain(rows, slips=True):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slips and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    by_hole = {}  # words by what is left of them without one letter, and by all of it
    for w in n:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_hole.setdefault(k, []).append(w)
    near = {w: set() for w in n}
    for group in by_hole.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect())


def test_the_query_equals_plain_rules(spark, sf):
    for d in (sf, sf.replace("0.001", "0.01")):
        rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
        want = plain(rows)
        assert got(QUERIES["op13_spelling"](spark, d)) == want and any(r[3] for r in want)


def test_random_words_of_few_letters(spark):
    rng = random.Random(3)
    made = ["".join(rng.choice("aabé") for _ in range(rng.randrange(5, 9))) for _ in range(900)]
    rows = [(i, " ".join(rng.choices(made, k=200))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows, slips=False)
    assert got(spelling.group_variants(df)) == want and max(r[2] for r in want) > 10


def test_chains_of_forms(spark):
    words = ["aaaaaaaa"[:8 - i] + "bbbbbbbb"[:i] for i in range(9)]
    rows = [(1, " ".join(w for i, w in enumerate(words) for _ in range(3 * 2**i)))]
    found = got(spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == plain(rows, slips=False) and {r[5] for r in found} == {"bbbbbbbb"}


def test_awkward_rows_and_long_runs(spark, awkward, nothing):
    more = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(50, " ".join(["y" * 4000] * 3 + ["y" * 3999] * 9 + ["×÷abc"] * 4)), (51, "Straße STRASSE Étés " * 5)], "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in more.collect()]
    assert got(spelling.group_variants(more.withColumns({"a.b": F.lit(1), "word": F.lit("w"), "sig": F.lit(2)}), slips=True)) == plain(rows)
    assert spelling.group_variants(nothing).count() == 0
