import hashlib
import re

from pyspark.sql import functions as F

from galleria.llm import common, decontaminate as C

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(C.UPPER, C.LOWER)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_brute_force(rows, items):
    found = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), C.WINDOW)
        for i in range(len(w) - n + 1 if w else 0):
            found.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, text in rows:
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in found}:
            for i in range(len(w) - n + 1):
                if (who := found.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    names |= {str(x) for x in who if x is not None}
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(str, out))


def test_against_brute_force(spark, sf, awkward, nothing):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    some = [(r.item_id, r.text) for r in items.collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = C.contamination(docs, items).collect()
    assert sorted(str(tuple(r)) for r in got) == by_brute_force([(r.doc_id, r.text) for r in docs.collect()], some)
    hard = [(1, "one"), (2, "Over the LAZY dog"), (3, None), (4, ""), (None, "quick brown"), (5, "number 4, and then it sleeps. the 3 quick brown fox jumps over the lazy dog number 9"), (5, "漢字 😀")]
    asked = spark.createDataFrame(hard, "item_id long, text string")
    got = C.contamination(awkward, asked).collect()
    assert sorted(str(tuple(r)) for r in got) == by_brute_force([(r.doc_id, r.text) for r in awkward.collect()], hard)
    assert C.contamination(nothing, asked).count() == 0
    assert C.contamination(awkward, asked.limit(0)).where("n_hit > 0").count() == 0


def test_contaminated_rows_go(awkward, spark):
    items = spark.createDataFrame([(1, "one"), (2, "dog number 9, and then")], "item_id long, text string")
    kept = C.decontaminate(awkward, items)
    assert kept.columns == awkward.columns
    bad = {str(x) for x in awkward.select("doc_id", "text").collect()} - {str(x) for x in kept.select("doc_id", "text").collect()}
    marked = C.measured(awkward, items).where("contaminated").select("doc_id", "h").collect()
    hashed = awkward.select("doc_id", "text", F.xxhash64("text").alias("g")).collect()
    assert bad and bad == {f"Row(doc_id={x.doc_id!r}, text={x.text!r})" for x in hashed if any((x.doc_id, x.g) == tuple(y) for y in marked)}


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    loose = "so alpha beta really gamma delta epsilon zeta eta theta iota kappa lambda mu nu it was"
    docs = spark.createDataFrame([(0, "x " + item + " y"), (1, loose), (2, "alpha and nothing else at all of the nu words")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    exact = {(r.doc_id, r.kind) for r in C.matches(docs, items).collect()}
    near = {(r.doc_id, r.kind) for r in C.matches(docs, items, slop=3).collect()}
    assert exact == {(0, "exact")} and {(0, "exact"), (1, "proximity")} <= near and not any(d == 2 for d, _ in near)


def test_terms_that_are_too_many_to_be_sent(spark, sf, awkward, monkeypatch):
    """The same rows, and no words below a shuffle but in the join that brings places back to their texts."""
    monkeypatch.setattr(common, "SMALL", -1)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = C.contamination(docs, items).collect()
    assert sorted(str(tuple(r)) for r in got) == by_brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    hard = [(1, "one"), (2, "Over the LAZY dog"), (None, "quick brown"), (5, "漢字 😀")]
    asked = spark.createDataFrame(hard, "item_id long, text string")
    got = C.contamination(awkward, asked).collect()
    assert sorted(str(tuple(r)) for r in got) == by_brute_force([(r.doc_id, r.text) for r in awkward.collect()], hard)
    wanted = spark.createDataFrame([(5, True)], "term long, context boolean")
    plan = C.looked_up(docs, wanted)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, line in enumerate(plan) if "Join Inner" in line and "term" in line)
    below = [line for line in plan[join + 1 :]]
    assert not any("Project" in line and "words#" in line.split("[", 1)[1].split("]")[0] and "term" in line for line in below)
