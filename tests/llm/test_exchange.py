"""Totals that do not fit 32 bits come back whole."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm import exchange


def test_totals_beyond_32_bits(spark):
    def send(batches):
        for b in batches:
            for block in b.column("id").to_pylist():
                keys = np.array([5, 1 << 60], np.uint64)
                yield exchange.requests(block, keys, [np.array([3_000_000_000, block + 1])], 2)

    def read(batches):
        for row, (total,) in exchange.by_block(batches, 1):
            yield pa.RecordBatch.from_arrays([row.column("block"), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["block", "total"])

    sent = spark.range(3).mapInArrow(send, exchange.request_schema(1))
    payload = spark.range(3).select(F.col("id").alias("block"), F.lit(None).cast("int").alias("bucket"))
    got = exchange.answered(payload, exchange.merged(sent, 1, 2), 1, 2).mapInArrow(
        read, T.StructType([T.StructField("block", T.LongType()), T.StructField("total", T.ArrayType(T.LongType()))]))
    assert {r["block"]: r["total"] for r in got.collect()} == dict.fromkeys(range(3), [9_000_000_000, 6])
