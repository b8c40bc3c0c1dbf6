"""Counting keys over a whole corpus and handing the counts back, block by block.

A *block* is a run of documents that one task holds at once (bounded text bytes),
named by the row id of its first document. It sends its distinct 64-bit keys with
their counts, sorted and packed, one row per key range (*bucket*); a bucket's task
adds the counts of all blocks and answers each block with the totals in the order of
the keys it sent. So a block's frequent key is one number however often it occurs
(pre-aggregated before the shuffle), and what travels is a few bytes per distinct
key and block, not a row per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scorelens.llm import common as C
from scorelens.llm.words import from_planes, pack_sorted, planes, unpack_sorted

BLOCK_BYTES = 12 << 20


def blocks(batches: Iterator[pa.RecordBatch], text: str = "__text", rid: str = "__rid",
           limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """(row id of the first row, rows as one chunk) of runs of at most ``limit`` text bytes
    or one row. The same for every pass over the same written table."""
    held, size = [], 0
    for piece in C.slices(batches, text, limit=1 << 20):
        col = C.column(piece, text)
        col = col if col.type in (pa.large_string(), pa.large_binary()) else col.cast(pa.large_binary())
        n = int(np.frombuffer(col.buffers()[1], np.int64, count=col.offset + len(col) + 1)[[col.offset, -1]] @ [-1, 1])
        if held and size + n > limit:
            t = pa.Table.from_batches(held).combine_chunks()
            yield t.column(rid)[0].as_py(), t
            held, size = [], 0
        held.append(piece)
        size += n
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t.column(rid)[0].as_py(), t


def bucket_edges(n_buckets: int) -> np.ndarray:
    """First key of every bucket but the first: equal ranges of the key space."""
    return np.array([(k << 64) // n_buckets for k in range(1, n_buckets)], np.uint64)


def request_schema(n_counts: int) -> T.StructType:
    return T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()),
                         T.StructField("keys", T.BinaryType())]
                        + [T.StructField(f"c{i}", T.BinaryType()) for i in range(n_counts)])


def requests(block: int, keys: np.ndarray, counts: list[np.ndarray], n_buckets: int) -> pa.RecordBatch:
    """The rows a block sends: ascending keys with their counts, by bucket."""
    ends = np.append(np.searchsorted(keys, bucket_edges(n_buckets)), len(keys))
    starts = np.append(0, ends[:-1])
    some = np.flatnonzero(ends > starts)
    cut = [slice(int(starts[b]), int(ends[b])) for b in some]
    cols = [pa.array(np.full(len(some), block), pa.int64()), pa.array(some, pa.int32()),
            pa.array([pack_sorted(keys[s]) for s in cut], pa.binary())]
    cols += [pa.array([planes(c[s], 4) for s in cut], pa.binary()) for c in counts]
    return pa.RecordBatch.from_arrays(cols, names=request_schema(len(counts)).names)


def merged(sent: DataFrame, n_counts: int, parts: int, n_stats: int = 0, stats=None) -> DataFrame:
    """Answers (block, bucket, c0.. totals in the order of the keys sent) and, if
    ``stats(keys, totals)`` is given, one row per bucket (block null) of its numbers."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType())]
                          + [T.StructField(f"c{i}", T.BinaryType()) for i in range(n_counts)]
                          + [T.StructField(f"s{i}", T.LongType()) for i in range(n_stats)])

    def answer(bucket: int, rows: list[dict]) -> pa.RecordBatch:
        each = [unpack_sorted(r["keys"]) for r in rows]
        size = [len(k) for k in each]
        keys, where = np.unique(np.concatenate(each), return_inverse=True)
        totals = [np.bincount(where, np.concatenate([from_planes(r[f"c{i}"], 4) for r in rows]), len(keys)).astype(np.int64)
                  for i in range(n_counts)]
        at = np.split(where, np.cumsum(size)[:-1])
        more = stats(keys, totals) if stats else []
        cols = [pa.array([r["block"] for r in rows] + [None], pa.int64()), pa.array([bucket] * (len(rows) + 1), pa.int32())]
        cols += [pa.array([planes(t[w], 8) for w in at] + [None], pa.binary()) for t in totals]
        cols += [pa.array([None] * len(rows) + [int(x)], pa.int64()) for x in more]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for r in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            if r["bucket"] != bucket and rows:
                yield answer(bucket, rows)
                rows = []
            bucket = r["bucket"]
            rows.append(r)
        if rows:
            yield answer(bucket, rows)

    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, schema)


def answered(payload: DataFrame, answers: DataFrame, n_counts: int, parts: int) -> DataFrame:
    """Each block's payload row followed by its answers, in one task, by bucket."""
    a = answers.where("block IS NOT NULL").select("block", "bucket", *[f"c{i}" for i in range(n_counts)])
    both = payload.unionByName(a, allowMissingColumns=True)
    return both.repartition(parts, "block").sortWithinPartitions("block", "bucket")


def by_block(batches: Iterator[pa.RecordBatch], n_counts: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """(payload row, totals in the order of the block's keys) from ``answered`` rows:
    the payload's bucket is null and comes first."""
    row, parts = None, [[] for _ in range(n_counts)]
    for b in batches:
        for k in range(b.num_rows):
            r = b.slice(k, 1)
            if C.column(r, "bucket")[0].as_py() is None:
                if row is not None:
                    yield row, [np.concatenate(p) if p else np.empty(0, np.uint64) for p in parts]
                row, parts = r, [[] for _ in range(n_counts)]
            elif row is not None:
                for i in range(n_counts):
                    parts[i].append(from_planes(C.column(r, f"c{i}")[0].as_py(), 8))
    if row is not None:
        yield row, [np.concatenate(p) if p else np.empty(0, np.uint64) for p in parts]
