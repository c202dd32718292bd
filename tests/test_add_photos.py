"""add_person_photos against its SQL where some documents are empty."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bare = F.col("doc_id") % 5 == 2
    docs.withColumns({"text": F.when(bare, "").otherwise(F.col("text")), "n_chars": F.when(bare, 0).otherwise(F.col("n_chars"))}).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.sql(__spark_entry__.oracle_sql()["add_person_photos"]).fetchall()
    got = __spark_entry__.queries()["add_person_photos"](spark, str(tmp_path)).select("index", "outcome").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r.outcome for r in got}) > 2
