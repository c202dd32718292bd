"""Every query with SQL against DuckDB on the same tables, all rows."""

import os

import duckdb
import pytest

import __spark_entry__
from galleria.plans import geometry
from test_functions import plain_iou

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf, duck):
    frame = __spark_entry__.queries()[name](spark, sf)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name in __spark_entry__.oracle_sql():
        result = duck.sql(__spark_entry__.oracle_sql()[name])
        assert got == rows_of(result.columns, result.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_greedy_suppression_against_a_loop(spark, sf):
    """Every image of the query, by plain loops."""
    boxes = {}
    for r in geometry.boxes(spark, sf).where("score >= 0.5").collect():
        boxes.setdefault(r.image, []).append((-r.score, r.id, tuple(r.box)))
    want = set()
    for image, found in boxes.items():
        kept = []
        for _, key, b in sorted(found):
            if not any(plain_iou(k, b) > 0.4 for _, k in kept):
                kept.append((key, b))
        want |= {(image, key) for key, _ in kept}
    got = [(r.image, r.id) for r in __spark_entry__.queries()["nms_greedy"](spark, sf).collect()]
    assert set(got) == want and len(got) == len(want)


def test_recall_of_the_approximate_search(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        exact, found = ({(r.query_id, r.sample_id) for r in __spark_entry__.queries()[n](spark, sf).collect()} for n in ("recognize_topk", "recognize_approximate"))
        assert len(exact & found) >= 0.9 * len(exact)
