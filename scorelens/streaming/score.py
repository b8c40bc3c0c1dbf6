"""Structured Streaming entry points.

The reference has no streaming; batch scoring (I-19) is the one operator that
also runs unchanged on a streaming DataFrame: a saved ``PipelineModel`` is a
stateless per-row transform, so ``readStream -> transform -> writeStream``
works with any sink and restarts from its checkpoint after a failure.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from scorelens.operators.importance import batch_score


def stream_source(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    """A file stream (parquet) with a fixed schema."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def score_stream(model: PipelineModel, stream: DataFrame, class_labels: list, keep: list[str] | None = None) -> DataFrame:
    return batch_score(model, stream, class_labels, keep)


def run_to_table(stream_df: DataFrame, checkpoint: str, sink_path: str, fmt: str = "parquet"):
    """Drain the available input once (``availableNow``) into a table; the
    checkpoint folder makes the run restartable (exactly-once file sink)."""
    q = (stream_df.writeStream.format(fmt).option("checkpointLocation", checkpoint)
         .option("path", sink_path).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q
