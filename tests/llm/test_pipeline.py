from pyspark.sql import functions as F

import corpus_pipeline
from galleria.llm import simhash


def test_stages_and_result(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n, kept = docs.columns, docs.count(), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() <= n
        n = docs.count()
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    whole = {(r.doc_id, r.n_tokens, r.decoded) for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {(r.doc_id, r.n_tokens, r.decoded) for r in docs.collect()}
    # No two documents that near-dedup leaves are as alike as its threshold, where their fingerprints are near.
    left = spark.read.parquet(str(tmp_path / "simhash_near_dedup")).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    codes = [(r.doc_id, r.text, simhash.simhash(r.text)) for r in left]
    for i, (_, a, x) in enumerate(codes):
        for _, b, y in codes[:i]:
            assert (x ^ y).bit_count() > 6 or simhash.similarity(a, b) < 0.8


def test_nothing_and_clashing_columns(spark, sf, nothing):
    empty = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = ("h", "u", "fp", "g", "d", "group", "template", "leaf", "score", "term", "pos", "words", "__d", "__h", "__drop", "__doc", "copied")
    clash = docs.withColumns({c: F.lit(7) for c in names})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
        out = stage(spark, clash, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == clash.columns and out.where(" OR ".join(f"{c} <> 7" for c in names)).isEmpty()
        assert 0 < out.count() <= 60


def test_awkward_documents(spark, sf, awkward):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() >= 5
