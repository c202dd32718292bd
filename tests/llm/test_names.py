"""Further columns of any name, those of the operators' own among them."""

import corpus_pipeline
from pyspark.sql import functions as F

from galleria.llm import line_templates, substrings

NAMES = ["a.b", "__drop", "__gone", "c`d", "drop", "c0"]


def test_columns_stay_whatever_their_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])
    for kept in (corpus_pipeline.drop_lines(spark, docs, sf), corpus_pipeline.reject_toxic(spark, docs, sf), substrings.dedup(docs)):
        assert kept.columns == docs.columns
        row = kept.first()
        assert [row[n] for n in NAMES] == list(range(len(NAMES)))
    assert line_templates.dedup(docs).where("n_dropped > 0").count() > 0
