"""Ranked lexical search with a document FP-tree and branch and bound.

1. *Terms.* The query items' terms are the vocabulary (items come in blocks of bounded
   size, so it is bounded too). One pass over all documents gives every document's
   number of terms and the frequencies of the vocabulary's terms in it; document
   counts, N and L are aggregations of that table.
2. *Tree.* Vocabulary terms are numbered by document count, most frequent first. A
   block of documents is sorted by these restricted term sequences; neighbours' common
   prefixes make them a trie, in which a node is a run of documents with the depth
   they share (held as the order and the prefix lengths, flat).
3. *Branch and bound.* Of a node's documents the maximum of each term's frequency and
   the minimum of m bound every item's score in the subtree from above, as a term's
   part grows with tf and falls with m. The tree is searched depth first, best child
   first, with the items that a node's bound still lets through; an item leaves a
   branch when its bound is below the score of its k-th best document so far. Small
   nodes are scored document by document. Blocks of a task hand their best on.

Scores are integers below 2^53 (checked), so that float64 products give them exactly.

Defined cases: a null or empty text, or one without terms, has none and is no result;
an item with a null text or without terms has no results; equal scores go by ascending
document id, null ids last; repeated rows are documents of their own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm import common as C
from scorelens.llm.toxicity import _Shared
from scorelens.llm.words import doc_words

ITEM_BLOCK = 1024
TREE_CELLS = 12 << 20  # documents x vocabulary of one tree
LEAF = 24              # documents that are scored rather than bounded

# every byte's replacement: terms are runs of ASCII letters (A-Z in lower case), digits
# and bytes of other characters; all else separates
_KEPT = np.array([b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256)], np.uint8)
_KEPT[65:91] += 32


def doc_terms(text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Term codes of all texts, the offset of each text's first one (and the end), and
    the distinct terms by code."""
    if not len(text):
        return np.empty(0, np.int64), np.zeros(1, np.int64), pa.array([], pa.large_string())
    off, data = text.buffers()[1], text.buffers()[2]
    size = int(np.frombuffer(off, np.int64, count=len(text) + 1)[-1])
    raw = _KEPT[np.frombuffer(data, np.uint8, count=size)] if size else np.zeros(0, np.uint8)
    return doc_words(pa.LargeStringArray.from_buffers(len(text), off, pa.py_buffer(raw)))


class Block:
    """A block of items: their vocabulary and how often each term occurs in each."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        codes, off, words = doc_terms(C.compact(pa.array([t or "" for _, t in items], pa.large_string())))
        self.words = words
        self.times = [Counter(codes[a:b].tolist()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def term_vectors(docs: DataFrame, shared: _Shared, id_col: str, text: str) -> DataFrame:
    """(id, n, codes ascending, tfs) of every document; codes of the block's vocabulary."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
                           T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in C.slices(batches, text):
            codes, off, words = doc_terms(C.texts(batch, text))
            to = pc.fill_null(pc.index_in(words.cast(pa.large_string()), value_set=known), -1).to_numpy(zero_copy_only=False)
            own = to[codes] if len(codes) else codes
            doc = np.repeat(np.arange(batch.num_rows), np.diff(off))[own >= 0]
            key, tf = np.unique(doc * max(len(known), 1) + own[own >= 0], return_counts=True)
            ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * max(len(known), 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
                     for x in (key % max(len(known), 1), tf)]
            yield pa.RecordBatch.from_arrays([C.column(batch, id_col), pa.array(np.diff(off)), *lists], names=schema.names)

    return docs.select(id_col, text).mapInArrow(run, schema)


class Weights:
    """Term weights of a block's items in the order of the tree: codes are renumbered by
    falling document count (``rank``); ``w`` is terms x items."""

    def __init__(self, block: Block, df: np.ndarray, n_docs: int):
        order = np.lexsort((np.arange(len(df)), -df))
        self.rank = np.empty(len(df), np.int64)
        self.rank[order] = np.arange(len(df))
        self.w = np.zeros((len(df), len(block.ids)))
        for i, times in enumerate(block.times):
            for code, k in times.items():
                self.w[self.rank[code], i] = k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df[code]) + 1)))
        if len(df) and self.w.sum(0).max(initial=0) * 1e6 >= 2 ** 53:
            raise ValueError("an item has too many terms for exact scores")


def part(tf: np.ndarray, m) -> np.ndarray:
    """A term's integer share of its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class FPTree:
    """Documents' frequencies [documents, terms by rank] and m, as a trie over the
    sequences of the terms that each one has."""

    def __init__(self, tf: np.ndarray, m: np.ndarray, name: np.ndarray):
        seqs = [np.flatnonzero(row) for row in tf]
        order = np.array(sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes()), np.int64)
        self.tf, self.m, self.name = tf[order], m[order], name[order]
        self.common = np.zeros(len(order), np.int64)  # shared depth with the document before
        for k in range(1, len(order)):
            a, b = seqs[order[k - 1]], seqs[order[k]]
            n = min(len(a), len(b))
            apart = np.flatnonzero(a[:n] != b[:n])
            self.common[k] = apart[0] if len(apart) else n

    def children(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The runs into which a node's documents part below the depth they share."""
        inner = self.common[lo + 1:hi]
        cuts = lo + 1 + np.flatnonzero(inner == inner.min())
        return list(zip([lo, *cuts.tolist()], [*cuts.tolist(), hi]))

    def bound(self, lo: int, hi: int, w: np.ndarray) -> np.ndarray:
        """No document of the run scores above this, by item (columns of ``w``)."""
        top = self.tf[lo:hi].max(0)
        there = np.flatnonzero(top)
        return part(top[there].astype(np.int64), self.m[lo:hi].min()).astype(np.float64) @ w[there]

    def scores(self, lo: int, hi: int, w: np.ndarray) -> np.ndarray:
        """[documents of the run, items]"""
        own = self.tf[lo:hi]
        there = np.flatnonzero(own.any(0))
        return part(own[:, there].astype(np.int64), self.m[lo:hi, None]).astype(np.float64) @ w[there]


class Best:
    """The k best (score, name) of every item; equal scores by the smaller name."""

    def __init__(self, items: int, k: int):
        self.k, self.score = k, np.zeros((items, k))
        self.name = np.full((items, k), np.iinfo(np.int64).max)
        self.least = np.zeros(items)  # an item's k-th best score, 0 while it has fewer

    def add(self, items: np.ndarray, scores: np.ndarray, names: np.ndarray) -> None:
        for col in np.flatnonzero((scores >= np.maximum(self.least[items], 1)).any(0)):
            i = items[col]
            s = np.concatenate([self.score[i], scores[:, col]])
            n = np.concatenate([self.name[i], names])
            keep = np.lexsort((n, -s))[:self.k]
            self.score[i], self.name[i] = s[keep], n[keep]
            self.least[i] = self.score[i, -1]


def search(tree: FPTree, w: np.ndarray, best: Best) -> int:
    """Depth-first branch and bound; returns how many documents were scored."""
    if not len(tree.m):
        return 0
    scored, every = 0, np.arange(w.shape[1])
    stack = [(0, len(tree.m), every, tree.bound(0, len(tree.m), w))]
    while stack:
        lo, hi, items, bound = stack.pop()
        on = bound >= np.maximum(best.least[items], 1)
        items = items[on]
        if not len(items):
            continue
        own = w[:, items]
        if hi - lo <= LEAF:
            scored += hi - lo
            best.add(items, tree.scores(lo, hi, own), tree.name[lo:hi])
            continue
        below = []
        for a, b in tree.children(lo, hi):
            if b - a <= 2:  # a bound costs as much as the scores
                scored += b - a
                best.add(items, tree.scores(a, b, own), tree.name[a:b])
            else:
                below.append((a, b, items, tree.bound(a, b, own)))
        stack.extend(sorted(below, key=lambda c: c[3].max()))
    return scored


def _best_of_parts(vectors: DataFrame, shared: _Shared, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item: position in the block, score, id) of the k best of every partition."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()), vectors.schema["id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        terms, items = weights.w.shape
        most = max(TREE_CELLS // max(terms, 1), LEAF)
        # names are places in ``ids``, which holds the ids of the best and of this tree
        best, ids = Best(items, k), None
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part_of = batch.slice(lo, most)
                ids = _tree_step(part_of, weights, n_docs, n_terms, best, ids)
        if ids is not None:
            item, place = np.nonzero(best.score > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item.astype(np.int32)), pa.array(best.score[item, place].astype(np.int64)),
                 ids.take(pa.array(best.name[item, place]))], names=schema.names)

    return vectors.mapInArrow(run, schema)


def _tree_step(batch: pa.RecordBatch, weights: Weights, n_docs: int, n_terms: int, best: Best, ids: pa.Array) -> pa.Array:
    """Search one more tree; returns the ids that the names in ``best`` point to."""
    col = C.column(batch, "codes")
    size = np.diff(col.offsets.to_numpy())
    doc = np.repeat(np.arange(batch.num_rows), size)
    tf = np.zeros((batch.num_rows, len(weights.rank)), np.int32)
    tf[doc, weights.rank[col.flatten().to_numpy()]] = C.column(batch, "tfs").flatten().to_numpy()
    n = C.column(batch, "n").to_numpy()
    m = np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], np.int64)
    # names must order like ids (nulls last) among the kept ones and the new ones
    used = np.unique(best.name[best.score > 0])
    pool = pa.concat_arrays([ids.take(pa.array(used)), C.column(batch, "id")]) if len(used) else C.column(batch, "id")
    order = pc.array_sort_indices(pool, null_placement="at_end").to_numpy()
    name = np.empty(len(order), np.int64)
    name[order] = np.arange(len(order))
    if len(used):
        there = best.score > 0
        best.name[there] = name[np.searchsorted(used, best.name[there])]
    some = size > 0
    search(FPTree(tf[some], m[some], name[len(used):][some]), weights.w, best)
    return pool.take(pa.array(order))


def _blocks(items: DataFrame, id_col: str, text: str, size: int) -> Iterator[list]:
    """The items with a text in blocks of ``size`` rows (the stated query set): one at a
    time on the driver, however many there are."""
    keyed = items.where(F.col(text).isNotNull()).select(F.col(id_col).alias("i"), F.col(text).alias("t"))
    n = math.ceil(keyed.count() / size)
    if n > 1:
        keyed = C.written(keyed.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n))))
    for b in range(n):
        yield (keyed.where(F.col("b") == b) if n > 1 else keyed).select("i", "t").collect()


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", item_block: int = ITEM_BLOCK) -> DataFrame:
    """Each item's k best documents: item id, rank, document id, score."""
    spark = docs.sparkSession
    C.prepare(spark)
    found = None
    for rows in _blocks(items, item_id, item_text, item_block):
        block = Block([tuple(r) for r in rows])
        vectors = C.written(term_vectors(docs, _Shared(spark, block.words), id_col, text))
        size = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        df = np.zeros(len(block.words), np.int64)  # as many rows as the block has terms
        for r in vectors.select(F.explode("codes").alias("c")).groupBy("c").count().collect():
            df[r[0]] = r[1]
        n_docs, n_terms = size["docs"], max(size["terms"] or 0, 1)
        top = _best_of_parts(vectors, _Shared(spark, Weights(block, df, n_docs)), n_docs, n_terms, k)
        names = spark.createDataFrame(list(enumerate(block.ids)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField(
            "__item", items.schema[item_id].dataType)]))
        ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(
            F.desc("score"), F.asc_nulls_last("id")))).where(F.col("rank") <= k)
        out = ranked.join(F.broadcast(names), "item").select(  # at most item_block rows
            F.col("__item").alias(item_id), "rank", F.col("id").alias(id_col), "score")
        found = out if found is None else found.unionByName(out)
    if found is None:
        return docs.limit(0).crossJoin(items.limit(0).select(F.col(item_id).alias("__item"))).select(
            F.col("__item").alias(item_id), F.lit(0).alias("rank"), id_col, F.lit(0).cast("long").alias("score"))
    return found


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP11_SQL = f"""
WITH d AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, a GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN size USING (doc_id), a GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
