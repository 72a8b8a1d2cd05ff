"""What a Python worker gets at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from worklore.llm import jaccard
from worklore.session import BATCH_BYTES


def test_arrow_batches_are_bounded_by_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 500).alias("text"))
    assert jaccard.near_duplicates(docs.limit(3)).count() == 3

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < BATCH_BYTES + 10_000
