"""Sizes of Arrow batches in any of Spark's forms."""

import pytest

from galleria.llm.common import BATCH_BYTES, bound_batches

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize(("given", "after"), [("4m", "4m"), ("1048576", "1048576"), ("64MB", str(BATCH_BYTES))])
def test_sizes_are_read_as_spark_reads_them(spark, given, after):
    spark.conf.set(NAME, given)
    try:
        bound_batches(spark)
        assert spark.conf.get(NAME) == after
    finally:
        spark.conf.unset(NAME)
