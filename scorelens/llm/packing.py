"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Best-two-fit (B2F): fill a bin greedily with the largest unpacked pieces that fit;
then, if a gap is left, take out its smallest piece when two unpacked pieces fit
the expanded gap more tightly than it did.

The algorithm looks at lengths only, and there are at most ``capacity`` different
lengths however many documents there are. So it runs on the histogram of lengths
(at most ``capacity`` counts on the driver, from a distributed count): a pattern
of lengths found for one bin is repeated as long as the counts allow, exactly as
the one-bin-at-a-time algorithm would repeat it. The plan (patterns x lengths, also
independent of the number of documents) goes to the tasks, where the r-th piece of
a length finds its sequence and offset by arithmetic. The rank r of a piece among
those of its length is its rank inside its map task plus the count of that length
in the tasks before it: no group of pieces ever meets in one task, a length that a
third of all pieces share costs nothing extra. Pieces of full length need no rank.

Defined cases: null and empty texts are documents of the end id alone; repeated
rows are packed as often as they occur; a text of any length is cut into pieces of
``capacity`` with a shorter first piece; an empty table gives no pieces; other
columns than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm import common as C
from scorelens.llm.tokens import encoder

CAPACITY = 1024
END_ID = 2


def cut_lengths(total: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of ``total`` tokens: index of the document, number of the
    piece, its start and its length. Only the first piece may be shorter."""
    count = np.maximum(1, -(-total // capacity))
    doc = np.repeat(np.arange(len(total)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    short = total - (count - 1) * capacity
    start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
    length = np.where(piece == 0, short[doc], capacity)
    return doc, piece, start, length


def ranks_within(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rank of every value among the equal ones, counting on from ``seen`` (updated)."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    new = np.append(True, v[1:] != v[:-1]) if len(v) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0)) if len(v) else np.zeros(0, np.int64)
    rank = np.empty(len(v), np.int64)
    rank[order] = np.arange(len(v)) - begin + seen[v]
    seen += np.bincount(values, minlength=len(seen))
    return rank


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Whole documents as pieces of at most ``capacity`` ids: id, piece, start,
    length, ids_crc32 (of the little-endian unsigned 32-bit ids), ids (if kept),
    and the task and the rank among the task's pieces of that length."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType()), T.StructField("__task", T.LongType()),
              T.StructField("__rank", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in C.slices(batches, text):
            ids, off = enc.encode(C.texts(batch, text), end_id)
            doc, piece, start, length = cut_lengths(np.diff(off), capacity)
            at = off[:-1][doc] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            cols = [C.column(batch, id_col).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array(np.full(len(doc), task), pa.int64()), pa.array(ranks_within(length, seen), pa.int64())]
            if keep_ids:
                # pieces follow each other in the ids, so their starts are the offsets
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(id_col, C.text_or_empty(text).alias(text)).mapInArrow(run, T.StructType(fields))


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (times, [(length, uses per bin), ...]) that pack ``counts[l]`` pieces
    of every length l <= capacity."""
    left = counts.astype(np.int64).copy()
    index = np.arange(capacity + 1)
    plan = []
    while left.any():
        free = left.copy()  # of this bin's point of view
        fits = np.maximum.accumulate(np.where(free > 0, index, 0))  # largest unpacked length <= x
        use: dict[int, int] = {}
        gap = capacity
        while gap > 0 and fits[gap] > 0:
            n = int(fits[gap])
            k = min(gap // n, int(free[n]))
            use[n] = use.get(n, 0) + k
            free[n] -= k
            gap -= k * n
            if free[n] == 0:
                fits = np.maximum.accumulate(np.where(free > 0, index, 0))
        if gap > 0:
            small = min(use)
            room = gap + small
            # two unpacked pieces a >= b with small < a + b <= room, a + b largest
            a = np.flatnonzero(free[:room] > 0)
            if len(a):
                b = fits[np.minimum(a, room - a)]
                same = (b == a) & (free[a] < 2)
                b[same] = fits[a[same] - 1]
                both = np.where(b > 0, a + b, 0)
                best = int(both.argmax())
                if both[best] > small:
                    use[small] -= 1
                    for n in (int(a[best]), int(b[best])):
                        use[n] = use.get(n, 0) + 1
        used = [(n, k) for n, k in sorted(use.items(), reverse=True) if k]
        times = min(int(left[n]) // k for n, k in used)
        for n, k in used:
            left[n] -= times * k
        plan.append((times, used))
    return plan


class Placement:
    """The plan as arrays: (length, rank) -> (sequence, offset)."""

    def __init__(self, plan: list, capacity: int):
        rank0 = np.zeros(capacity + 1, np.int64)
        rows, sequence = [], 0
        for times, used in plan:
            offset = 0
            for n, k in used:
                rows.append((n, rank0[n], k, sequence, offset))
                rank0[n] += times * k
                offset += n * k
            sequence += times
        self.sequences = sequence
        rows.sort()
        self.length, self.rank, self.uses, self.sequence, self.offset = (
            np.array(x, np.int64) for x in (zip(*rows) if rows else [[]] * 5))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.int64(44)
        at = np.searchsorted((self.length << shift) + self.rank, (length << shift) + rank, side="right") - 1
        r = rank - self.rank[at]
        return self.sequence[at] + r // self.uses[at], self.offset[at] + (r % self.uses[at]) * length


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (columns length, __task, __rank: see ``token_pieces``; a written
    table) with ``sequence_id`` and ``offset``. Full pieces get negative numbers."""
    short = pieces.where(F.col("length") < capacity)
    per_task = short.groupBy("__task", "length").agg(F.count(F.lit(1)).alias("__n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for n, k in per_task.groupBy("length").agg(F.sum("__n")).collect():  # at most ``capacity`` rows
        histogram[n] = k
    place = Placement(best_two_fit(histogram, capacity), capacity)
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__task")) - F.col("__n")
    offsets = per_task.select("__task", "length", before.alias("__before"))
    found = pieces.sparkSession.sparkContext.broadcast(place)  # size bounded by the capacity

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = found.value
        for b in batches:
            seq, off = plan.find(C.column(b, "length").to_numpy(), C.column(b, "__at").to_numpy())
            keep = [i for i, n in enumerate(b.schema.names) if n not in ("__at", "__task", "__rank")]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(seq), pa.array(off)],
                                             names=[b.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    out_cols = [c for c in pieces.columns if c not in ("__task", "__rank")]
    schema = T.StructType([pieces.schema[c] for c in out_cols]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    ranked = short.join(offsets, ["__task", "length"]).select(
        *pieces.columns, (F.col("__rank") + F.col("__before")).alias("__at"))
    full = pieces.where(F.col("length") == capacity).select(
        *out_cols, (-1 - F.shiftleft("__task", 40) - F.col("__rank")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(locate, schema).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Tokenise whole documents and pack them: one row per piece with its place."""
    C.prepare(docs.sparkSession)
    return pack_pieces(C.written(token_pieces(docs, tokenizer, id_col, text, capacity, end_id, keep_ids)), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = C.table(spark, sf_dir, "documents")
    out = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
