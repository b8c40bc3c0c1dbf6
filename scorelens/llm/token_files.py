"""Token-id files compressed by a Re-Pair grammar, with random access.

``write_token_files`` sorts the documents by id over all tasks, encodes whole texts,
and cuts each task's stream of ids into shards. In a shard frequent pairs of ids are
replaced by new symbols (rules), round by round: the most frequent pairs that do not
overlap with a more frequent one are replaced together, and their symbols can be
parts of later pairs, until no pair is frequent. Pairs never reach over the end of a
document, so a document is a run of symbols.

A shard is one binary value (layout below) in a row of a Parquet table in the
cluster's file system: Spark's commit protocol makes a lost task's shard come again
whole. Each rule stores its two parts and its expansion length, and each document
its first symbol, so ids [a, b) of a document are decoded by skipping over
expansions without decoding what lies before.

Layout, little-endian: magic ``RPG1``; six uint32: documents, ids, symbols, rules,
first rule's number, ids' number of byte planes (3 or 4); then uint32 ids per
document; uint32 first symbol per document; uint32 left and right parts of the
rules; uint32 expansion lengths; the symbols as byte planes (all lowest bytes first).

Defined cases: null and empty texts are the end id alone; equal or null document
ids stand side by side (null first, equal ones by text); an empty table makes an
empty table; other columns than id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm import common as C
from scorelens.llm.tokens import encoder

SHARD_IDS = 1 << 20
MIN_COUNT = 24
END_ID = 0
_HEAD = struct.Struct("<4s6I")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _choose(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of pairs (left << 32 | right) the most frequent ones such that no symbol is
    the left part of one and the right part of another: no two occurrences overlap
    (but those of a pair of equal parts). Ascending."""
    order = np.argsort(-counts, kind="stable")
    lefts, rights, chosen = set(), set(), []
    for p in pairs[order].tolist():
        a, b = p >> 32, p & 0xFFFFFFFF
        if a == b:
            if a in lefts or a in rights:
                continue
        elif a in rights or b in lefts:
            continue
        lefts.add(a)
        rights.add(b)
        chosen.append(p)
    return np.array(sorted(chosen), np.int64)


def _frequent(key: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys that occur min_count times or more, and their counts."""
    s = np.sort(key)
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(s)))
    often = n >= min_count
    return s[first[often]], n[often]


def _index_in(key: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of every key in an ascending table, -1 where it has none. A hash slot names one
    entry; entries that lost their slot to another one are searched for."""
    bucket = lambda x: (x.view(np.uint64) * _MULTIPLIER >> np.uint64(44)).view(np.int64)
    slots = bucket(table)
    slot = np.full(1 << 20, -1, np.int32)
    slot[slots] = np.arange(len(table), dtype=np.int32)
    named = slot.take(bucket(key))
    out = np.where(table.take(named, mode="wrap") == key, named, np.int32(-1))     # slot -1: the last entry, which differs
    lost = np.flatnonzero(slot[slots] != np.arange(len(table)))
    if len(lost):
        shared = np.zeros(len(table), bool)
        shared[slot[slots[lost]]] = True
        at = np.flatnonzero((named >= 0) & (out < 0))
        at = at[shared[named[at]]]
        found = np.minimum(np.searchsorted(table, key[at]), len(table) - 1)
        out[at] = np.where(table[found] == key[at], found, -1)
    return out


def re_pair(ids: np.ndarray, end_id: int, first_rule: int,
            min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules [n, 2]); rule k is symbol ``first_rule + k``. Ends when no pair occurs
    ``min_count`` times (occurrences of a pair of equal parts counted with overlaps).

    Symbols keep their places and are linked past those that went. A pair that is not
    frequent can never become so (its occurrences only go away), unless it holds a new
    symbol: a round looks at ``live`` places only, those of frequent pairs and those beside
    a replacement, so late rounds are small."""
    s = ids.astype(np.int32)
    n = len(s)
    after, before = np.arange(1, n + 1), np.arange(-1, n)     # n: the stream's end; places are of numpy's own index type
    s = np.append(s, np.int32(end_id))
    alive = np.ones(n + 1, bool)
    live = None                     # first all places: neighbours are read without a link
    rules: list[np.ndarray] = []
    made = 0
    while True:
        a, b = (s[:-1], s[1:]) if live is None else (s.take(live), s.take(after.take(live)))
        inside = np.flatnonzero((a != end_id) & (b != end_id))
        live = inside if live is None else live.take(inside)
        key = (a.take(inside).astype(np.int64) << 32) | b.take(inside)
        pairs, counts = _frequent(key, min_count)
        if not len(pairs):
            break
        place = _index_in(key, pairs)
        some = np.flatnonzero(place >= 0)
        live, place = live.take(some), place.take(some)
        chosen = _choose(pairs, counts)
        symbol = np.full(len(pairs), -1, np.int32)
        symbol[np.searchsorted(pairs, chosen)] = first_rule + made + np.arange(len(chosen))
        new = symbol.take(place)
        some = np.flatnonzero(new >= 0)
        at, new = live.take(some), new.take(some)
        # runs of one symbol: every second occurrence, counted from the run's start
        gone = after.take(at)
        twin = s.take(at) == s.take(gone)
        if twin.any():
            follows = np.append(False, twin[1:] & twin[:-1] & (at[1:] == after[at[:-1]]))
            start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            use = ~twin | ((np.arange(len(at)) - start) % 2 == 0)
            at, new, gone = at[use], new[use], gone[use]
        s[at] = new
        alive[gone] = False
        next_ = after.take(gone)
        after[at] = next_
        before[next_] = at
        # a round's places stay in order: occurrences of a run are told by their neighbours
        mark = np.zeros(n + 1, bool)
        mark[live] = True
        mark[at] = True
        mark[before.take(at)] = True      # -1, before the stream, marks its end, which is no place
        mark &= alive
        live = np.flatnonzero(mark[:n])
        rules.append(np.stack([chosen >> 32, chosen & 0xFFFFFFFF], 1))
        made += len(chosen)
    return s[:n][alive[:n]], np.concatenate(rules) if rules else np.empty((0, 2), np.int64)


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that each rule stands for (a rule's parts are ids or earlier rules)."""
    out = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    while len(todo):
        part = rules[todo]
        sub = np.where(part >= first_rule, out[np.maximum(part - first_rule, 0)], 1)
        ready = (sub > 0).all(1)
        out[todo[ready]] = sub[ready].sum(1)
        todo = todo[~ready]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids that the symbols stand for; one pass for each level of the grammar."""
    s = symbols.astype(np.int64)
    while True:
        inner = s >= first_rule
        if not inner.any():
            return s.astype(np.int32)
        width = np.where(inner, 2, 1)
        ends = np.cumsum(width)
        out = np.empty(int(ends[-1]), np.int64)
        out[ends[~inner] - 1] = s[~inner]
        part = rules[s[inner] - first_rule]
        out[ends[inner] - 2], out[ends[inner] - 1] = part[:, 0], part[:, 1]
        s = out


def pack_shard(ids: np.ndarray, per_doc: np.ndarray, end_id: int, first_rule: int, **how) -> bytes:
    symbols, rules = re_pair(ids, end_id, first_rule, **how)
    lengths = expansion_lengths(rules, first_rule)
    width = np.where(symbols >= first_rule, lengths[np.maximum(symbols - first_rule, 0)] if len(lengths) else 1, 1)
    starts = np.cumsum(width) - width
    first = np.searchsorted(starts, np.cumsum(per_doc) - per_doc)
    planes = 3 if first_rule + len(rules) < 1 << 24 else 4
    raw = symbols.astype("<u4").view(np.uint8).reshape(-1, 4).T[:planes]
    u4 = lambda x: np.ascontiguousarray(x).astype("<u4").tobytes()
    return b"".join([_HEAD.pack(b"RPG1", len(per_doc), len(ids), len(symbols), len(rules), first_rule, planes),
                     u4(per_doc), u4(first), u4(rules[:, 0]), u4(rules[:, 1]), u4(lengths), raw.tobytes()])


class Shard:
    """A shard's bytes, read."""

    def __init__(self, data: bytes):
        magic, docs, self.n_ids, n, rules, self.first_rule, planes = _HEAD.unpack_from(data)
        if magic != b"RPG1":
            raise ValueError("not a token shard")
        at = _HEAD.size

        def u4(k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, "<u4", k, at).astype(np.int64)
            at += 4 * k
            return out

        self.per_doc, self.first = u4(docs), u4(docs)
        self.rules = np.stack([u4(rules), u4(rules)], 1)
        self.lengths = u4(rules)
        raw = np.zeros((4, n), np.uint8)
        raw[:planes] = np.frombuffer(data, np.uint8, planes * n, at).reshape(planes, n)
        self.symbols = np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)

    def all_ids(self) -> np.ndarray:
        # every rule expanded once, then one gather
        flat = np.concatenate([np.arange(self.first_rule, dtype=np.int32),
                               expand(np.arange(len(self.rules)) + self.first_rule, self.rules, self.first_rule)])
        lens = np.concatenate([np.ones(self.first_rule, np.int64), self.lengths])
        starts = np.cumsum(lens) - lens
        return C.ragged_take(flat, starts[self.symbols], lens[self.symbols])

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids [start, stop) of one document: only the symbols that cover them are expanded."""
        stop = int(self.per_doc[doc]) if stop is None else min(stop, int(self.per_doc[doc]))
        end = self.first[doc + 1] if doc + 1 < len(self.first) else len(self.symbols)
        s = self.symbols[self.first[doc]:end]
        width = np.where(s >= self.first_rule, self.lengths[np.maximum(s - self.first_rule, 0)] if len(self.lengths) else 1, 1)
        ends = np.cumsum(width)
        i, j = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        skipped = int(ends[i - 1]) if i else 0
        return expand(s[i:j], self.rules, self.first_rule)[start - skipped:max(start, stop) - skipped]


FILE_SCHEMA = T.StructType([T.StructField("task", T.LongType()), T.StructField("shard", T.IntegerType()),
                            T.StructField("task_start", T.LongType()), T.StructField("n_ids", T.LongType()),
                            T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])


def write_token_files(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text: str = "text",
                      end_id: int = END_ID, shard_ids: int = SHARD_IDS, min_count: int = MIN_COUNT) -> None:
    """Write the shards of all documents, in ascending order of ``id_col``, to ``path``."""
    spark = docs.sparkSession
    C.prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        first_rule = enc.tok.get_vocab_size(with_added_tokens=True)
        task, shard, written = TaskContext.get().partitionId(), 0, 0
        held_ids, held_docs, held_counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, written, held
            ids, counts = np.concatenate(held_ids), np.concatenate(held_counts)
            names = pa.concat_arrays(held_docs)
            data = pack_shard(ids, counts, end_id, first_rule, min_count=min_count)
            out = pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int64()), pa.array([shard], pa.int32()), pa.array([written], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                 pa.array([data], pa.binary())], names=FILE_SCHEMA.names)
            shard, written, held = shard + 1, written + len(ids), 0
            held_ids.clear()
            held_docs.clear()
            held_counts.clear()
            return out

        for batch in C.slices(batches, text):
            ids, off = enc.encode(C.texts(batch, text), end_id)
            names, a = C.column(batch, id_col).cast(pa.int64()), 0
            # a batch may fill several shards: each ends with the document that fills it
            while a < batch.num_rows:
                b = min(int(np.searchsorted(off, off[a] + shard_ids - held)), batch.num_rows)
                held_ids.append(ids[off[a]:off[b]])
                held_counts.append(np.diff(off[a:b + 1]))
                held_docs.append(names[a:b])
                held += int(off[b] - off[a])
                a = b
                if held >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    src = docs.select(F.col(id_col).cast("long").alias(id_col), C.text_or_empty(text).alias(text))
    (src.repartitionByRange(C.partitions(spark), id_col).sortWithinPartitions(id_col, text)
        .mapInArrow(run, FILE_SCHEMA).write.option("compression", "zstd").parquet(path))


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it),
    n_tokens, ids_crc32 and, if kept, its ids."""
    C.prepare(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # one number per writing task: bounded by the number of tasks, whatever the input
    totals = sorted((r[0], r[1]) for r in files.groupBy("task").agg(F.sum("n_ids")).collect())
    before, so_far = {}, 0
    for task, n in totals:
        before[task] = so_far
        so_far += n
    fields = [T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()),
              T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                shard = Shard(C.column(row, "data")[0].as_py())
                ids, n = shard.all_ids(), shard.per_doc
                ends = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - w):4 * e]) for e, w in zip(ends.tolist(), n.tolist())]
                start = before[C.column(row, "task")[0].as_py()] + C.column(row, "task_start")[0].as_py() + ends - n
                cols = [C.column(row, "doc_ids").flatten(), pa.array(start), pa.array(n), pa.array(crc, pa.int64())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return files.select("task", "task_start", "doc_ids", "data").mapInArrow(run, T.StructType(fields))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = C.scratch_path(spark)
    write_token_files(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_files(spark, path, keep_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
