"""Searches that keep the best of each probe in a task: equal to plain rules, no pairs are shuffled."""

import numpy as np

from galleria.operators import topk as T, vector_index as I

K = 4


def vectors(n=400, dim=12, seed=5):
    m = np.round(np.random.default_rng(seed).standard_normal((n, dim)), 2)
    m[50:90] = m[0]  # ties
    return m


def frames(spark, m):
    gallery = spark.createDataFrame([(i, i % 5, v.tolist()) for i, v in enumerate(m)], "sample_id long, person_id long, embedding array<double>")
    return gallery.where("sample_id % 3 = 0").select(gallery.sample_id.alias("query_id"), "embedding"), gallery


def plain(m, asked, may):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.where(may, np.round(unit @ unit.T, 6), -9)
    np.fill_diagonal(scores, -9)
    return sorted((q, int(s), r + 1) for q in asked for r, s in enumerate(np.lexsort((np.arange(len(m)), -scores[q]))[:K]) if scores[q, s] > -9)


def rows(df):
    return sorted((r.query_id, r.sample_id, r["rank"]) for r in df.collect())


def test_approximate_search_equals_the_rule_of_bands(spark, monkeypatch):
    m = vectors()
    queries, gallery = frames(spark, m)
    bands, bits = T.band_plan(len(m), 0.9, 0.95)
    planes = np.random.default_rng(42).standard_normal((12, bands * bits))
    keys = (m @ planes >= 0).reshape(-1, bands, bits) @ (1 << np.arange(bits))
    want = plain(m, range(0, len(m), 3), (keys[:, None] == keys[None]).any(2))
    for most, told in ((10_000, 1 << 26), (30, 1000)):
        monkeypatch.setattr(T, "PROBES_AT_ONCE", most)
        monkeypatch.setattr(T, "TOLD_AT_ONCE", told)
        assert rows(T.approximate_topk(queries, gallery, 12, K, 0.9)) == want
    assert rows(T.approximate_topk(queries.limit(0), gallery, 12, K, 0.9)) == []


def test_candidates_are_not_shuffled(spark):
    """Pairs of candidates were joined with both tables' vectors, which took many times the input on disk."""
    queries, gallery = frames(spark, vectors())
    plan = T.approximate_topk(queries, gallery, 12, K, 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_keep_best_in_parts_of_any_size():
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 6, (20, 300)) / 10
    scores[rng.random(scores.shape) < 0.3] = -np.inf
    scores[3] = -np.inf
    scores[4] = 0.5
    own = rng.permutation(300)
    for width in (1, 7, 300):
        best, owners = np.full((20, K), -np.inf), np.zeros((20, K), np.int64)
        for left in range(0, 300, width):
            for part in (np.arange(0, 8), np.arange(8, 20)):
                T.keep_best(best, owners, part, scores[part, left : left + width], own[left : left + width])
        for q in range(20):
            order = np.lexsort((own, -scores[q]))[:K]
            want = [(scores[q, i], own[i]) for i in order if scores[q, i] > -np.inf]
            assert [(b, o) for b, o in zip(best[q], owners[q], strict=True) if b > -np.inf] == want


def test_cells_are_told_in_slices(spark, tmp_path, monkeypatch):
    """Cosines of a whole batch with all centres took gigabytes where these are thousands; so did a row for each query and cell."""
    m = vectors()
    queries, gallery = frames(spark, m)
    index = I.build(gallery, str(tmp_path / "i"), cells=23)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.argsort(-np.round(unit @ index.centres.T, 6), axis=1, kind="stable")
    monkeypatch.setattr(I, "AT_ONCE", 23 * 40)
    slices = list(index.probed(unit, 5))
    told = np.concatenate(slices)
    assert len(slices) == 10 and (told.sum(1) == 5).all() and told[np.arange(len(m))[:, None], near[:, :5]].all()
    assert (I._nearest(unit, index.centres) == near[:, 0]).all()
    monkeypatch.setattr(I, "PROBES_AT_ONCE", 30)
    cell = {r.sample_id: r.cell for r in index.vectors(spark).select("sample_id", "cell").collect()}
    may = told[:, [cell[i] for i in range(len(m))]]
    assert rows(I.search(index, queries, K, 5)) == plain(m, range(0, len(m), 3), may)
    assert rows(I.search(index, queries, K, 23)) == plain(m, range(0, len(m), 3), np.ones_like(may))
    # Each task sends on K rows a query at most; it was K rows for each query, cell and batch.
    sent = I._searched(index, spark, np.arange(0, len(m), 3), unit[::3], K, 23, None)
    assert sent.count() <= K * len(m[::3]) * sent.rdd.getNumPartitions()
