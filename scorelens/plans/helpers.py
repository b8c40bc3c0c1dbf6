"""Small plan-shape helpers shared by the operators."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.session import tables_root


def to_long(df: DataFrame, cols: list[str], ids: list[str] | None = None,
            name: str = "feature", value: str = "value") -> DataFrame:
    """Wide -> long (id..., feature, value) with every value cast to double."""
    ids = ids or []
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot(ids, cols, name, value)


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _WRITING = threading.Lock(), {}


@contextmanager
def shuffles_go(spark: SparkSession):
    """What is run inside leaves no shuffle files behind: a step whose result is a table (or
    has come back) does not need them, and until the driver's garbage collection happens to
    find them, the disk holds those of all steps so far. The session's setting is restored."""
    key = spark.sparkContext.applicationId
    with _LOCK:
        n, was = _WRITING.get(key, (0, None))
        if not n:
            was = spark.conf.get(SHUFFLES_GO, None)
            spark.conf.set(SHUFFLES_GO, "true")
        _WRITING[key] = n + 1, was
    try:
        yield
    finally:
        with _LOCK:
            n, was = _WRITING[key]
            _WRITING[key] = n - 1, was
            if n == 1:
                spark.conf.unset(SHUFFLES_GO) if was is None else spark.conf.set(SHUFFLES_GO, was)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once as a parquet table into the cluster's
    shared checkpoint folder and read it back.

    Unlike ``Dataset.checkpoint(eager=True)`` (which runs its input once to
    count and again to save the RDD) this computes the input a single time,
    stores it columnar, and the table survives executor loss. Its shuffle files go with
    the write. ``release_tables`` deletes what an application has written.
    """
    spark = df.sparkSession
    path = f"{tables_root(spark)}/{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def grand_mean(cols: list[str]):
    """Mean over all non-null cells of a column group (N2: nulls skipped)."""
    num = None
    den = None
    for c in cols:
        s = F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0))
        n = F.count(F.col(c))
        num = s if num is None else num + s
        den = n if den is None else den + n
    return F.try_divide(num, den.cast("double"))
