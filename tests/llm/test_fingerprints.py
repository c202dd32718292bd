import hashlib

import numpy as np

from galleria.llm import chunks, fingerprints as P


def test_boundaries_come_back_after_an_insertion():
    rng = np.random.default_rng(3)
    text = "".join(chr(97 + c) for c in rng.integers(0, 26, 20_000))
    a, b = P.chunk_set(text), P.chunk_set("inserted here " + text)
    assert P.containment(a, b) > 0.98
    ends = chunks.boundaries(chunks.code_points(text), P.SIZES)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= P.SIZES.most and sizes[:-1].min() >= P.SIZES.least
    assert 0.7 * P.SIZES.normal < sizes.mean() < 1.5 * P.SIZES.normal


def test_gear_hash_by_its_definition():
    points = chunks.code_points("Some words, é 漢 😀 and then some more of them to fill a window.")
    gear = (chunks.scrambled(points) >> np.uint64(32)).tolist()
    for i, h in enumerate(chunks.gear_hash(points).tolist()):
        assert h == sum(gear[i - k] << k for k in range(min(i, 31) + 1)) % (1 << 32)


def brute_force(rows):
    rows = sorted(((d is not None, d or 0, t or "") for d, t in rows))
    for (known, d, t), (_, _, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        yield (d if known else None), t, after, P.edited(t, after)


def check(frame):
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = sorted(P.fingerprints(frame).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.edited_sha256))
    want = sorted(brute_force(rows), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(x[3].encode()).hexdigest()))
    assert len(got) == len(want)
    for r, (d, t, after, changed) in zip(got, want, strict=True):
        own = P.chunk_set(t)
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d, len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert P.parse(r.fingerprint) == own and r.fingerprint == P.fingerprint(own)
        assert r.near_edited == P.containment(own, P.chunk_set(changed)) and r.near_next == P.containment(own, P.chunk_set(after))


def test_against_brute_force(spark, sf, awkward):
    check(spark.read.parquet(f"{sf}/documents.parquet"))
    check(awkward)


def test_query_separates(spark, sf):
    import __spark_entry__

    out = __spark_entry__.queries()["op5_fingerprints"](spark, sf).where("n_chars >= 200").toPandas()
    assert out.near_edited.mean() > 0.6 and out.near_next.mean() < 0.2


def test_nothing(nothing):
    assert P.fingerprints(nothing).count() == 0
