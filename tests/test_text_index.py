"""Pattern search by trigrams against ILIKE over all texts."""

import pytest
from pyspark.sql import functions as F

from galleria.operators import text_index as X

NAMES = ["Ada Lovelace", "ada", "Grace HOPPER", "Émile Zola", "100% sure", "under_score", "back\\slash", "", "aaa", "aaaa", "İstanbul", "漢字かな", None, "Grace Kelly", "Ada Lovelace"]
PATTERNS = ["%ada%", "%LOVE%", "%gr_ce%", "%grace%k_lly", "ada", "%a_a%", "%zola", "%100\\%%", "%under\\_s%", "%aaa%", "%", "%zzz%", "%かな%", "%漢字か%", "%émile%", "_ada%", "", "%istan%", "%hop%grace%"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("names") / "x")
    texts = spark.createDataFrame(list(enumerate(NAMES)), "id long, text string").repartition(3)
    X.build(texts, path)
    return texts, path


@pytest.mark.parametrize("pattern", PATTERNS)
def test_equal_to_a_scan(spark, index, pattern):
    texts, path = index
    want = sorted((r.id, r.text) for r in texts.where(F.col("text").ilike(pattern)).collect())
    assert sorted((r.id, r.text) for r in X.search(spark, path, pattern).collect()) == want


def test_ten_patterns_over_real_names(spark, tmp_path):
    names = spark.read.parquet("/root/testdata/sf0.01/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    X.build(names, str(tmp_path / "x"))
    for pattern in ("%9_1%", "%#00000_1%", "%0091%", "customer%77", "%CUST%00_7_", "%11%22%", "%_999%", "%mer#0000010%", "%000001500", "%nobody%"):
        got = sorted(r.id for r in X.search(spark, str(tmp_path / "x"), pattern).collect())
        assert got == sorted(r.id for r in names.where(F.col("text").ilike(pattern)).collect())


def test_only_postings_of_two_grams_are_read(spark, index):
    plan = X.search(spark, index[1], "%lovelace%")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(gram,") == 2 and plan.count("Location") == 2


def test_no_texts(spark, tmp_path):
    X.build(spark.createDataFrame([], "id long, text string"), str(tmp_path / "x"))
    assert X.search(spark, str(tmp_path / "x"), "%abc%").count() == 0 and X.search(spark, str(tmp_path / "x"), "%").count() == 0
