"""Helpers the operators of this package share: written tables in the cluster's
shared folder, internal column names, size-checked batches of an Arrow stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.session import ensure_checkpoint_dir, ship_package, tables_root

# Bytes of words that a worker remembers with what was found for them.
REMEMBERED_BYTES = 64 << 20
# Text bytes a Python worker handles at once (memory bound, results do not depend on it).
SLICE_BYTES = 8 << 20


_HELD: dict = {}


def held(key, make):
    """The worker's tables ``key``, made once. A worker is used again by later stages: it
    holds those of one operator at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``."""
    return f"{tables_root(spark)}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` once (zstd Parquet, shared folder), read it back.
    What follows survives lost executors without running the input again."""
    spark = df.sparkSession
    path = scratch_path(spark)
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_ids(df: DataFrame, rid: str = "__rid") -> DataFrame:
    """Freeze ``df`` in a written table with a unique row id, so that null or
    repeated keys cannot confuse later joins."""
    return written(df.select(F.monotonically_increasing_id().alias(rid), "*"))


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """Input columns named like an output column of the operator give way to it."""
    gone = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in gone])


def aside(df: DataFrame, keep: list[str]) -> DataFrame:
    """``df`` with neutral names for all columns but ``keep``, so that none can clash
    with an internal column; ``toDF(*df.columns)`` gives them back."""
    return df.toDF(*[c if c in keep else f"__column{i}" for i, c in enumerate(df.columns)])


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(doc_id="doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def keyed_join(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of many rows with a table unique on the key. Both sides come from
    written tables, so Spark knows their sizes: it broadcasts a small ``few`` (within
    its threshold), and otherwise splits the partition of a hot key (adaptive skew join)."""
    return rows.join(few, on)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut the batches of a stream into pieces of at most ``limit`` text bytes
    (one row at least), whole rows only."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        if col.type not in (pa.large_string(), pa.large_binary()):
            col = col.cast(pa.large_binary())
        off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=col.offset + n + 1)[col.offset:]
        start = 0
        while start < n:
            stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), n)
            yield batch.slice(start, stop - start)
            start = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.LargeStringArray:
    """The text column as large_string without nulls, its buffers cut to these rows."""
    return compact(column(batch, name))


def compact(col: pa.Array) -> pa.LargeStringArray:
    """A text array as large_string without nulls whose offsets start at 0 (string
    kernels are not all right on arrays that are part of a larger buffer)."""
    import pyarrow.compute as pc
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return pa.array([], pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64, count=col.offset + n + 1)[col.offset:]
    data = col.buffers()[2]
    if data is None or off[-1] == off[0]:
        return pa.array([""] * n, pa.large_string())
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(off - off[0]), data.slice(int(off[0]), int(off[-1] - off[0])))


def ragged_take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenate flat[starts[i] : starts[i] + lens[i]] for all i, vectorised."""
    lens = lens.astype(np.int64, copy=False)
    total = int(lens.sum())
    if total == 0:
        return flat[:0]
    ends = np.cumsum(lens)
    shift = np.repeat(starts.astype(np.int64, copy=False) - (ends - lens), lens)
    return flat[np.arange(total, dtype=np.int64) + shift]
