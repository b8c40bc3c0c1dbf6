"""N-gram Jaccard join with a prefix tree.

Two documents link when their sets of distinct word n-grams overlap in at least
9 parts of 10 of their union (the share is a parameter); the result is every
document's connected component under these links.

1. *Who can link at all.* In any order of the n-grams, of x's first 2d + 1 (d = the
   most n-grams in which x may differ from a partner) more than d lie among the
   partner's first 3d' + 1. So every document publishes that many of its smallest
   keys, their document counts are gathered (``exchange``), and a document with at
   most d shared ones among its first 2d + 1 links with nothing. No cap, no chance.
2. Equal sets are collapsed to one; counts of all n-grams among these sets give the
   global order, rarest first. Sets with more than d unshared n-grams leave.
3. Sets that share one of their d + 1 rarest n-grams are candidates; the components
   of this relation (``components``) are clusters that no link leaves.
4. In a cluster, sets are stored in a prefix tree in the global order (frequent
   n-grams first, so near copies share long paths). A set is matched against the
   tree by one traversal that carries the overlap so far; a subtree is left when
   what remains of the lengths cannot reach the share any more.

A large cluster is dealt over many tasks, each with a tree of the same few members
(``clusters``), so that a huge group of near copies takes work in proportion to its
size, and no link is lost.

Defined cases: null, empty and white-space texts have no n-grams and no links;
texts with fewer words than n have one n-gram, the whole sequence; repeated rows
link (they are equal); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm import common as C
from scorelens.llm import exchange as X
from scorelens.llm.clusters import Limits, cluster_links
from scorelens.llm.components import components
from scorelens.llm.words import chain_keys, doc_words, from_planes, keys_of, planes

LIMITS = Limits()


class Share:
    """The least share num / den of the union that an overlap must have, exactly."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den or 2 * num <= den:
            raise ValueError("the share must be over one half and at most one")
        self.num, self.den = num, den

    def linked(self, both: int, x: int, y: int) -> bool:
        return self.den * both >= self.num * (x + y - both)

    def differ(self, n):
        """Most elements in which a set of n may differ from a partner, both ways together."""
        return n * (self.den - self.num) // self.num

    def partner(self, n):
        """Largest size of a partner."""
        return n * self.den // self.num


def shingle_sets(text: pa.LargeStringArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct n-gram keys of all texts, and each text's offset (and the end)."""
    codes, off, words = doc_words(text)
    word = keys_of(words)[codes] if len(codes) else np.empty(0, np.uint64)
    size = np.diff(off)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(size)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + off[:-1][doc]
    key = np.empty(len(doc), np.uint64)
    long = size[doc] >= n
    if long.any():
        s = start[long]
        key[long] = chain_keys(*[word[s + k] for k in range(n)])
    for k in np.flatnonzero(~long):  # at most one for each short text
        a, m = start[k], int(size[doc[k]])
        key[k] = chain_keys(np.array([m], np.uint64), *[word[a + i:a + i + 1] for i in range(m)])[0]
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(len(size) + 1))


class PrefixTree:
    """Sets as sequences in the global order; common beginnings are stored once."""

    def __init__(self, sequences: list[np.ndarray]):
        order = sorted(range(len(sequences)), key=lambda i: sequences[i].byteswap().tobytes())
        self.tokens: list[np.ndarray] = [np.empty(0, np.uint64)]
        self.depth, self.children, self.ends = [0], [[]], [[]]
        path = [0]  # nodes from the root to the last sequence's end
        last = np.empty(0, np.uint64)
        for i in order:
            s = sequences[i]
            m = min(len(s), len(last))
            differ = np.flatnonzero(s[:m] != last[:m])
            common = int(differ[0]) if len(differ) else m
            while len(path) > 1 and self.depth[path[-2]] >= common:
                path.pop()
            top = path[-1]
            if self.depth[top] > common:  # split this node at the common depth
                parent = path[-2]
                upper = self._node(self.tokens[top][:common - self.depth[parent]], common)
                self.tokens[top] = self.tokens[top][common - self.depth[parent]:]
                self.children[upper] = [top]
                self.children[parent][self.children[parent].index(top)] = upper
                path[-1] = upper
                top = upper
            if len(s) > common:
                node = self._node(s[common:], len(s))
                self.children[top].append(node)
                path.append(node)
            self.ends[path[-1]].append(i)
            last = s
        size = [len(s) for s in sequences]
        self.least, self.most = [0] * len(self.depth), [0] * len(self.depth)
        stack = [(0, False)]
        while stack:
            v, ready = stack.pop()
            if not ready:
                stack.append((v, True))
                stack.extend((c, False) for c in self.children[v])
            else:
                lens = [size[i] for i in self.ends[v]]
                self.least[v] = min(lens + [self.least[c] for c in self.children[v]], default=0)
                self.most[v] = max(lens + [self.most[c] for c in self.children[v]], default=0)

    def _node(self, tokens: np.ndarray, depth: int) -> int:
        self.tokens.append(tokens)
        self.depth.append(depth)
        self.children.append([])
        self.ends.append([])
        return len(self.depth) - 1

    def matches(self, keys: np.ndarray, share: Share) -> Iterator[int]:
        """The stored sets that link with the set ``keys`` (ascending)."""
        n = len(keys)
        stack = [(0, 0)]
        while stack:
            v, overlap = stack.pop()
            own = self.tokens[v]
            if len(own):
                at = np.minimum(np.searchsorted(keys, own), n - 1)
                overlap += int(np.count_nonzero(keys[at] == own))
            d, least, most = self.depth[v], self.least[v], self.most[v]
            # stored n-grams that the set lacks, and the overlap that the rest may bring
            if d - overlap > share.differ(min(n, most)):
                continue
            reach = overlap + min(most - d, n - overlap)
            if share.den * reach < share.num * max(n, least):
                continue
            for i in self.ends[v]:
                if share.linked(overlap, n, d):
                    yield i
            stack.extend((c, overlap) for c in self.children[v])


def tree_links(members: list[tuple[int, np.ndarray]], pivots: list[tuple[int, np.ndarray]],
               share: Share) -> list[tuple[int, int]]:
    """Links between members and pivots that join their components: a spanning forest."""
    tree = PrefixTree([s for _, s in pivots])
    parent: dict[int, int] = {r: r for r, _ in members} | {r: r for r, _ in pivots}
    apart = len(parent)

    def root(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    out = []
    for r, s in members:
        if apart == 1:
            break
        for i in tree.matches(np.sort(s), share):
            a, b = root(r), root(pivots[i][0])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((r, pivots[i][0]))
                apart -= 1
    return out


def _published(src: DataFrame, n: int, share: Share, parts: int, id_type) -> DataFrame:
    """(__rid, __id, n_shingles, may_link) of every document: step 1."""
    n_buckets = 2 * parts

    def parts_of(table: pa.Table):
        text = table.column("__text").combine_chunks()
        text = C.compact(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
        keys, off = shingle_sets(text, n)
        size = np.diff(off)
        doc = np.repeat(np.arange(len(size)), size)
        rank = np.arange(len(keys)) - off[:-1][doc]
        shown = rank < 3 * share.differ(share.partner(size))[doc] + 1
        tested = rank < 2 * share.differ(size)[doc] + 1
        sent, count = np.unique(keys[shown], return_counts=True)
        return keys, size, doc, tested, sent, count

    def send(batches):
        for block, table in X.blocks(batches):
            *_, sent, count = parts_of(table)
            yield X.requests(block, sent, [count], n_buckets)

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("rids", T.ArrayType(T.LongType())),
                           T.StructField("ids", T.ArrayType(id_type)), T.StructField("size", T.BinaryType()),
                           T.StructField("tested", T.BinaryType())])

    def send_tests(batches):
        for block, table in X.blocks(batches):
            keys, size, doc, tested, sent, _ = parts_of(table)
            one = lambda c: table.column(c).combine_chunks()  # noqa: B023, E731
            flat = lambda a: a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), flat(one(c))) for c in ("__rid", "__id")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), *arrays, pa.array([planes(size, 4)], pa.binary()),
                 pa.array([planes(np.searchsorted(sent, keys[tested]), 4)], pa.binary())], names=schema.names)

    out = T.StructType([T.StructField("__rid", T.LongType()), T.StructField("__id", id_type),
                        T.StructField("n_shingles", T.LongType()), T.StructField("may_link", T.BooleanType())])

    def test(batches):
        for row, (count,) in X.by_block(batches, 1):
            size = from_planes(C.column(row, "size")[0].as_py(), 4).astype(np.int64)
            tested = np.where(size > 0, 2 * share.differ(size) + 1, 0)
            common = count[from_planes(C.column(row, "tested")[0].as_py(), 4)] > 1
            doc = np.repeat(np.arange(len(size)), tested)
            shared = np.bincount(doc, common, len(size))
            ok = (size > 0) & (shared > share.differ(size))
            yield pa.RecordBatch.from_arrays([C.column(row, "rids").flatten(), C.column(row, "ids").flatten(),
                                              pa.array(size), pa.array(ok)], names=out.names)

    answers = C.written(X.merged(src.select("__rid", "__text").mapInArrow(send, X.request_schema(1)), 1, parts))
    payload = src.mapInArrow(send_tests, schema).select("*", F.lit(None).cast("int").alias("bucket"))
    return C.written(X.answered(payload, answers, 1, parts).mapInArrow(test, out))


SET = T.StructType([T.StructField("__rid", T.LongType()), T.StructField("digest", T.BinaryType()),
                    T.StructField("keys", T.BinaryType())])


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """The n-gram sets of texts: ascending keys, and a digest that equal sets share."""
    def run(batches):
        for batch in C.slices(batches, "__text"):
            keys, off = shingle_sets(C.texts(batch, "__text"), n)
            raw = keys.astype("<u8").tobytes()
            own = [raw[8 * a:8 * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [C.column(batch, "__rid"), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in own], pa.binary()),
                 pa.array(own, pa.binary())], names=SET.names)
    return docs.mapInArrow(run, SET)


def _ordered(sets: DataFrame, share: Share, parts: int) -> DataFrame:
    """Step 2: (__rid, n, keys in the global order, frequent first; rare: the shared
    ones of the d + 1 rarest) of the sets with at most d unshared n-grams."""
    n_buckets = 2 * parts

    def block_keys(table: pa.Table):
        own = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
        return own, np.unique(np.concatenate(own), return_counts=True)

    def send(batches):
        for block, table in X.blocks(batches, "keys"):
            _, (keys, count) = block_keys(table)
            yield X.requests(block, keys, [count], n_buckets)

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("rids", T.ArrayType(T.LongType())),
                           T.StructField("sets", T.ArrayType(T.BinaryType()))])

    def send_sets(batches):
        for block, table in X.blocks(batches, "keys"):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([table.column("__rid").to_pylist()], pa.list_(pa.int64())),
                 pa.array([table.column("keys").to_pylist()], pa.list_(pa.binary()))], names=schema.names)

    out = T.StructType([T.StructField("__rid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("seq", T.BinaryType()),
                        T.StructField("rare", T.ArrayType(T.LongType()))])

    def order(batches):
        for row, (count,) in X.by_block(batches, 1):
            own = [np.frombuffer(x, "<u8") for x in C.column(row, "sets")[0].as_py()]
            all_keys = np.unique(np.concatenate(own))
            rows = []
            for rid, keys in zip(C.column(row, "rids")[0].as_py(), own):
                df = count[np.searchsorted(all_keys, keys)]
                d = share.differ(len(keys))
                if np.count_nonzero(df < 2) > d:
                    continue
                by = np.lexsort((keys, df))  # rarest first
                rare = by[:d + 1]
                rows.append((rid, len(keys), keys[by[::-1]].tobytes(), keys[rare[df[rare] > 1]].view(np.int64)))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=out.names)

    cols = sets.select("__rid", "keys")
    answers = C.written(X.merged(cols.mapInArrow(send, X.request_schema(1)), 1, parts))
    payload = cols.mapInArrow(send_sets, schema).select("*", F.lit(None).cast("int").alias("bucket"))
    return C.written(X.answered(payload, answers, 1, parts).mapInArrow(order, out))


def _groups(src: DataFrame, n: int, share: Share, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Of rows (__rid, __id, __text, ...; a written table): (__rid, __id, n_shingles,
    may_link) of all, and (__rid, root, __id) of those in a group, root naming it."""
    parts = C.partitions(src.sparkSession)
    flags = _published(src.select("__rid", "__id", "__text"), n, share, parts, src.schema["__id"].dataType)

    may = flags.where("may_link").select("__rid").hint("merge")
    every = C.written(_sets(src.select("__rid", "__text").join(may, "__rid"), n))
    same = C.written(every.groupBy("digest").agg(F.min("__rid").alias("rep")))
    member = C.written(C.keyed_join(every.select("__rid", "digest"), same, ["digest"]).select("__rid", "rep"))
    reps = C.written(every.join(same.select(F.col("rep").alias("__rid")).hint("merge"), "__rid").select("__rid", "keys"))
    sets = _ordered(reps, share, parts)

    rare = sets.select("__rid", F.explode("rare").alias("key"))
    hubs = rare.groupBy("key").agg(F.min("__rid").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    close = C.keyed_join(rare, C.written(hubs.select("key", "hub")), ["key"])
    clusters = components(close.select(F.col("__rid").alias("a"), F.col("hub").alias("b"))).select(
        F.col("node").alias("__rid"), F.col("root").alias("cluster"))
    links = cluster_links(sets, clusters, lambda members, pivots: tree_links(members, pivots or members, share), limits, parts)
    linked = components(links).select(F.col("node").alias("rep"), "root")

    rooted = member.select("rep").distinct().join(linked.hint("merge"), "rep", "left").select(
        "rep", F.coalesce("root", "rep").alias("root"))
    placed = C.keyed_join(member, C.written(rooted), ["rep"]).select("__rid", "root")
    return flags, C.written(placed.join(flags.select("__rid", "__id").hint("merge"), "__rid"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 3,
                       num: int = 9, den: int = 10, limits: Limits = LIMITS) -> DataFrame:
    """Every document's id, n_shingles and component_id (least id that links reach)."""
    C.prepare(docs.sparkSession)
    src = C.with_row_ids(docs.select(F.col(id_col).alias("__id"), C.text_or_empty(text).alias("__text")))
    flags, placed = _groups(src, n, Share(num, den), limits)
    least = C.written(placed.groupBy("root").agg(F.min("__id").alias("least")))
    named = C.keyed_join(placed.select("__rid", "root"), least, ["root"]).select("__rid", "least")
    return flags.join(named.hint("merge"), "__rid", "left").select(
        F.col("__id").alias(id_col), "n_shingles", F.coalesce("least", "__id").alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 8, den: int = 10,
              limits: Limits = LIMITS) -> DataFrame:
    """``docs`` with one row of every component: that of the least id (null ids last)."""
    C.prepare(docs.sparkSession)
    src = C.with_row_ids(C.aside(docs, [id_col, text]))
    _, placed = _groups(src.withColumns({"__id": F.col(id_col), "__text": C.text_or_empty(text)}), n, Share(num, den), limits)
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__rid").alias("rid"))
    first = C.written(placed.groupBy("root").agg(F.min(order).alias("m")).select("root", F.col("m.rid").alias("stays")))
    gone = C.keyed_join(placed.select("__rid", "root"), first, ["root"]).where("__rid <> stays").select("__rid")
    return src.join(gone.hint("merge"), "__rid", "left_anti").drop("__rid").toDF(*docs.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(C.table(spark, sf_dir, "documents"))
