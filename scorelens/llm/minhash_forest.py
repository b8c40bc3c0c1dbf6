"""Near-duplicate documents by MinHash and an LSH forest.

1. *Signatures.* A document's set of distinct word n-grams gives the minima of
   ``TREES x PREFIX`` hash functions. Equal sets are collapsed to one.
2. *Forest.* Every tree is an order of all signatures: by its own ``PREFIX`` minima,
   then by bytes of the common ones (the *sketch*). All trees are sorted at once, by
   ranges, so that no prefix, however frequent, has to fit one task. Neighbours whose
   longest common prefix is the tree's own minima or more form a *region*. In a region
   sketches are compared: two sets are candidates if as many bytes agree as sets of the
   asked share have but once in ten million. The depth is adaptive: a region of more
   than ``REGION`` sets is split by the bytes that follow until its parts are small
   enough; then only what is outside the largest group so far is compared with all the
   region. A region emits edges of a star for each group, never its pairs.
3. *Clusters* are the components of the candidates (``components``); their sets, made
   again from the texts, are compared in full (``clusters``), which confirms links and
   finds those between members that no tree had made neighbours.

Two sets of similarity s share a prefix in one of the trees with probability
1 - (1 - s^5)^24: 0.9999992 for 0.85 (what the query asks), 0.99999999 for 0.89. A link
is lost only if no chain of candidates connects its ends either.

Defined cases: null, empty and white-space texts have no n-grams and no links; texts
with fewer words than n have one n-gram, the whole sequence; repeated rows link (they
are equal); of groups, the row with the least id is kept (null ids last; of repeated
rows with that id all are); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm import common as C
from scorelens.llm.clusters import Limits, Members, cluster_links
from scorelens.llm.components import EDGE, components
from scorelens.llm.jaccard_join import Share, shingle_sets

TREES, PREFIX, SKETCH = 24, 5, 48
REGION = 1024
LOST = 1e-7             # chance that a linked pair's sketches agree in too few bytes
LIMITS = Limits(small=1024, chunk=512, pivots=64, more=512, weight=2 << 20)
SLICE_BYTES = 2 << 20   # text whose n-grams stay in a core's cache

_A = np.random.default_rng(20).integers(1, 1 << 32, TREES * PREFIX, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = np.random.default_rng(21).integers(0, 1 << 32, TREES * PREFIX, dtype=np.uint64).astype(np.uint32)


def signatures(keys: np.ndarray, off: np.ndarray) -> np.ndarray:
    """[sets, functions]: 16 bits of the minimum of every hash function; rows of empty
    sets are 0."""
    size = np.diff(off)
    out = np.zeros((len(size), len(_A)), np.uint16)
    some = np.flatnonzero(size)
    if len(some):
        x = (keys ^ (keys >> np.uint64(32))).astype(np.uint32)
        for i in range(len(_A)):
            out[some, i] = np.minimum.reduceat(x * _A[i] + _B[i], off[:-1][some]) & np.uint32(0xFFFF)
    return out


def least_agreeing(share: float, of: int = SKETCH, lost: float = LOST) -> int:
    """The most bytes k such that fewer than k of ``of`` agree with probability at most ``lost``."""
    tail, k = 0.0, 0
    while (tail := tail + math.comb(of, k) * share ** k * (1 - share) ** (of - k)) <= lost:
        k += 1
    return k


def near_groups(sketch: np.ndarray, n: np.ndarray, share: Share, least: int) -> np.ndarray:
    """Each row's group: the first row that candidates connect it with."""
    label = np.full(len(n), -1)
    rest = np.arange(len(n))
    for seed in range(len(n)):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        rest, todo = rest[label[rest] < 0], [seed]
        while todo and len(rest):
            x = todo.pop()
            small, large = np.minimum(n[rest], n[x]), np.maximum(n[rest], n[x])
            hit = (share.den * small >= share.num * large) & ((sketch[rest] == sketch[x]).sum(1) >= least)
            label[rest[hit]] = seed
            todo.extend(rest[hit].tolist())
            rest = rest[~hit]
    return label


def region_groups(sketch: np.ndarray, n: np.ndarray, share: Share, least: int, most: int = REGION, depth: int = 0) -> np.ndarray:
    """``near_groups`` of a region sorted by sketch. A large one is first split at greater
    depths; then what lies outside the largest group is compared with all the rest, so
    that the result is the same."""
    if len(n) <= most or depth == sketch.shape[1]:
        return near_groups(sketch, n, share, least)
    label = np.empty(len(n), np.int64)
    cuts = np.flatnonzero(np.diff(sketch[:, depth].astype(np.int64))) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)]):
        label[a:b] = a + region_groups(sketch[a:b], n[a:b], share, least, most, depth + 1)
    groups, size = np.unique(label, return_counts=True)
    main = groups[size.argmax()]
    for x in np.flatnonzero(label != main).tolist():
        if label[x] == label[main]:
            continue  # has come to the largest group: the others are compared with it
        small, large = np.minimum(n, n[x]), np.maximum(n, n[x])
        away = np.flatnonzero((label != label[x]) & (share.den * small >= share.num * large))
        hit = np.unique(label[away[(sketch[away] == sketch[x]).sum(1) >= least]])
        if len(hit):
            both = np.append(hit, label[x])
            label[np.isin(label, both)] = both.min()
    return label


SIGNED = [T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())]


def _signed(src: DataFrame, n: int) -> DataFrame:
    """(__rid, __id, n, digest of the set, signature) of every document."""
    schema = T.StructType([src.schema["__rid"], src.schema["__id"], *SIGNED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "__text", SLICE_BYTES):
            keys, off = shingle_sets(C.texts(batch, "__text"), n)
            raw, sig = keys.astype("<u8").tobytes(), signatures(keys, off)
            ends = off.tolist()
            yield pa.RecordBatch.from_arrays(
                [C.column(batch, "__rid"), C.column(batch, "__id"), pa.array(np.diff(off)),
                 pa.array([hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() for a, b in zip(ends, ends[1:])], pa.binary()),
                 pa.array([x.tobytes() for x in sig], pa.binary())], names=schema.names)

    return src.select("__rid", "__id", "__text").mapInArrow(run, schema)


# a signature's place in one tree: the tree and its first minimum, the next four, the sketch
PLACE = T.StructType([T.StructField("head", T.IntegerType()), T.StructField("tail", T.LongType()),
                      T.StructField("sketch", T.BinaryType()), T.StructField("__rid", T.LongType()), T.StructField("n", T.LongType())])


def _placed(reps: DataFrame) -> DataFrame:
    """A row for every set (__rid, n, sig) and tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                m = part.num_rows
                sig = np.frombuffer(b"".join(C.column(part, "sig").to_pylist()), np.uint16).reshape(m, TREES, PREFIX)
                sketch = np.ascontiguousarray(sig.reshape(m, -1)[:, :SKETCH].astype(np.uint8))
                sketch = pa.array([x.tobytes() for x in sketch], pa.binary())
                for t in range(TREES):
                    own = sig[:, t].astype(np.uint64)
                    tail = own[:, 1] << np.uint64(48) | own[:, 2] << np.uint64(32) | own[:, 3] << np.uint64(16) | own[:, 4]
                    head = (t << 16 | own[:, 0].astype(np.int64)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(tail.view(np.int64)), sketch, C.column(part, "__rid"),
                                                      C.column(part, "n")], names=PLACE.names)

    return reps.mapInArrow(run, PLACE)


def _candidates(reps: DataFrame, share: Share, parts: int, most: int) -> DataFrame:
    """(a, b): stars of the candidate groups of every tree's regions."""
    least = least_agreeing(share.num / share.den)

    def stars(head, tail, sketch, rid, n):
        """Edges of all complete regions of sorted rows."""
        new = np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))
        starts = np.append(np.flatnonzero(new), len(head))
        a, b = [], []
        for k in np.flatnonzero(np.diff(starts) > 1):
            s = slice(starts[k], starts[k + 1])
            own, label = rid[s], region_groups(sketch[s], n[s], share, least, most)
            hub = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(hub, label, own)
            away = own != hub[label]
            a.append(own[away])
            b.append(hub[label][away])
        return [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [C.column(batch, c) for c in PLACE.names]
            sketch = np.frombuffer(b"".join(cols[2].to_pylist()), np.uint8).reshape(batch.num_rows, SKETCH)
            own = [cols[0].to_numpy(), cols[1].to_numpy(), sketch, cols[3].to_numpy(), cols[4].to_numpy()]
            if held is not None:
                own = [np.concatenate(x) for x in zip(held, own)]
            # the last region may go on in the next batch
            last = np.flatnonzero((own[0] != own[0][-1]) | (own[1] != own[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [x[cut:] for x in own]
            if cut:
                yield pa.RecordBatch.from_arrays(stars(*[x[:cut] for x in own]), names=EDGE.names)
        if held is not None:
            yield pa.RecordBatch.from_arrays(stars(*held), names=EDGE.names)

    order = PLACE.names[:4]
    return _placed(reps).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, EDGE)


SET = T.StructType([T.StructField("__rid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("seq", T.BinaryType())])


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """The whole n-gram sets of texts, as ascending keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "__text"):
            keys, off = shingle_sets(C.texts(batch, "__text"), n)
            ends = off.tolist()
            yield pa.RecordBatch.from_arrays(
                [C.column(batch, "__rid"), pa.array(np.diff(off)),
                 pa.array([keys[a:b].astype("<u8").tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=SET.names)

    return docs.mapInArrow(run, SET)


def confirmed(members: Members, pivots: Members | None, share: Share) -> list[tuple[int, int]]:
    """Links of full sets that connect all that links connect: each set that is reached
    is counted against all that are not."""
    rows = members + (pivots or [])
    size = np.array([len(s) for _, s in rows])
    off = np.append(0, np.cumsum(size))
    _, code = np.unique(np.concatenate([s for _, s in rows]), return_inverse=True)
    mark = np.zeros(int(code.max()) + 1, np.int32)
    rest = np.argsort(-size, kind="stable")
    flat, first = C.ragged_take(code, off[rest], size[rest]), np.append(0, np.cumsum(size[rest])[:-1])
    gone = np.zeros(len(rows), bool)
    out, todo, seed = [], [], 0
    order = rest
    while True:
        if not todo:
            while seed < len(order) and gone[order[seed]]:
                seed += 1
            if seed == len(order):
                return out
            todo.append(int(order[seed]))
            gone[order[seed]] = True
        x = todo.pop()
        live = ~gone[rest]
        if 2 * live.sum() < len(rest):  # leave out what has been reached
            rest = rest[live]
            flat, first = C.ragged_take(code, off[rest], size[rest]), np.append(0, np.cumsum(size[rest])[:-1])
            live = live[live]
        if not len(rest):
            continue
        own = code[off[x]:off[x + 1]]
        mark[own] = 1
        # sets are held by falling size: only a run of them can link by size
        lo = int(np.searchsorted(-size[rest], -(size[x] * share.den // share.num)))
        hi = int(np.searchsorted(-size[rest], -(size[x] * share.num // share.den), side="right"))
        if lo < hi:
            end = first[hi] if hi < len(rest) else len(flat)
            both = np.add.reduceat(mark[flat[first[lo]:end]], first[lo:hi] - first[lo])
            near = rest[lo:hi]
            hit = near[live[lo:hi] & (share.den * both >= share.num * (size[near] + size[x] - both))]
            gone[hit] = True
            todo.extend(hit.tolist())
            out.extend((rows[i][0], rows[x][0]) for i in hit.tolist())
        mark[own] = 0


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 8, den: int = 10,
                    limits: Limits = LIMITS, region: int = REGION) -> DataFrame:
    """Every document's id, n_shingles, component_id (least id that links reach) and
    kept (its id is that one)."""
    spark = docs.sparkSession
    C.prepare(spark)
    parts, share = C.partitions(spark), Share(num, den)
    src = C.with_row_ids(docs.select(F.col(id_col).alias("__id"), C.text_or_empty(text).alias("__text")))
    signed = C.written(_signed(src, n))
    same = C.written(signed.where("n > 0").groupBy("digest").agg(F.min("__rid").alias("rep")))
    reps = C.written(signed.select("__rid", "n", "sig").join(same.select(F.col("rep").alias("__rid")).hint("merge"), "__rid"))

    clusters = components(_candidates(reps, share, parts, region)).select(
        F.col("node").alias("__rid"), F.col("root").alias("cluster"))
    sets = C.written(_sets(src.select("__rid", "__text").join(clusters.select("__rid").hint("merge"), "__rid"), n))
    links = cluster_links(sets, clusters, lambda members, pivots: confirmed(members, pivots, share), limits, parts)
    linked = components(links).select(F.col("node").alias("rep"), "root")

    # the least id among the rows of each set, then of each component
    sets_of = C.written(signed.where("n > 0").groupBy("digest").agg(F.min("__id").alias("id")).join(same.hint("merge"), "digest")
                        .join(linked.hint("merge"), "rep", "left").select("digest", "id", F.coalesce("root", "rep").alias("root")))
    least = C.written(sets_of.groupBy("root").agg(F.min("id").alias("least")))
    named = C.written(C.keyed_join(sets_of.select("digest", "root"), least, ["root"]).select("digest", "least"))
    out = signed.select("__id", "n", "digest").join(named.hint("merge"), "digest", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("__id"))
    return out.select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("__id").eqNullSafe(component).alias("kept"))


def op13_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), n=3, num=85, den=100)
