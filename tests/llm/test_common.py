"""Helpers that all training-data operators share."""

import pyarrow as pa
from pyspark.sql import functions as F

from quirelake.llm.common import ARROW_BYTES, in_arrow

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def largest(spark):
    """Bytes and rows of the largest batch that Python gets of 300 texts of 100 000 characters in one task."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "n"])

    made = in_arrow(spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text")), run, "size long, n long")
    return made.agg(F.max("size"), F.sum("n")).first()


def test_python_gets_few_bytes_at_a_time_unless_a_number_is_named(spark):
    size, n = largest(spark)
    assert n == 300 and size <= ARROW_BYTES + 200_000
    try:
        spark.conf.set(LIMIT, 16 << 20)
        size, n = largest(spark)
        assert n == 300 and size > 10 << 20
    finally:
        spark.conf.unset(LIMIT)
