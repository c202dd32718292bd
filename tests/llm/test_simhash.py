import numpy as np
import xxhash

from galleria.llm import simhash as S


def by_definition(text, k=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_fingerprint_by_definition(awkward):
    for (text,) in awkward.select("text").collect():
        if text is None or len(text) < 10_000:
            assert S.simhash(text or "") == by_definition(text or "")


def close_codes(rng, n):
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    found = [base]
    for flips in (1, 2, 3, 5):
        x = base.copy()
        for _ in range(flips):
            x ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        found.append(x)
    return np.unique(np.concatenate(found))


def test_index_against_all_pairs():
    rng = np.random.default_rng(1)
    codes = close_codes(rng, 150)
    buckets = rng.integers(0, 3, len(codes))
    for radius in (0, 2, 6):
        index = S.Index(codes, buckets)
        found = {(i, j): d for a, b, off in index.within(radius) for i, j, d in zip(a.tolist(), b.tolist(), off.tolist(), strict=True)}
        n, c = len(codes), index.codes
        apart = {(i, j): int(c[i] ^ c[j]).bit_count() for i in range(n) for j in range(i + 1, n) if index.buckets[i] == index.buckets[j]}
        assert found == {p: d for p, d in apart.items() if d <= radius}
        first, second = S.forest(n, index.within(radius))
        assert roots(n, zip(first.tolist(), second.tolist(), strict=True)) == roots(n, found)
        assert len(first) == n - len(set(roots(n, found)))


def components_by_brute_force(rows):
    fps = [by_definition(t or "") for _, t in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d is not None, d or 0, f"{f:016x}", least[r]) for (d, _), f, r in zip(rows, fps, root, strict=True)))


def test_components_against_brute_force(spark, sf, awkward, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for frame in (docs, awkward.where("length(text) < 10000 OR text IS NULL")):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        got = sorted(((r.doc_id is not None, r.doc_id or 0, r.fingerprint, r.component_id) for r in S.near_duplicates(frame).collect()))
        assert got == components_by_brute_force(rows)
    assert S.near_duplicates(nothing).count() == 0


def test_large_buckets_are_dealt_out_again(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST", 20)
    rng = np.random.default_rng(2)
    codes = np.unique(np.concatenate([close_codes(rng, 40), (rng.integers(0, 2**30, 300, dtype=np.uint64) | np.uint64(0xABCD << 48))]))
    frame = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    edges = [(r.a, r.b) for r in S.components(S.links(frame, 2, 4)).selectExpr("node AS a", "root AS b").collect()]
    place = {int(x): i for i, x in enumerate(codes.view(np.int64))}
    want = [(i, j) for i in range(len(codes)) for j in range(i) if int(codes[i] ^ codes[j]).bit_count() <= 2]
    assert roots(len(codes), [(place[a], place[b]) for a, b in edges]) == roots(len(codes), want)


def test_long_chain_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_one_of_each_group_stays(spark, awkward, nothing):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words), " ".join([*words[:150], "new", *words[151:]]), " ".join(f"v{i}" for i in range(300)), "", None]
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, h int")
    assert sorted(r.doc_id for r in S.drop_near_duplicates(frame).collect()) == [0, 3, 4]
    kept = S.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert kept.where("text = 'one'").count() == 1
    assert S.drop_near_duplicates(nothing).count() == 0
