"""Approximate nearest neighbours: a hierarchical navigable small-world graph per
shard, stored as flat neighbour arrays; shard results are merged.

Vectors are dealt to shards of at most about ``shard_rows`` rows by a hash of their
id. A shard's distinct vectors are put in descending order of their random level, so
layer l of the graph is the first n_l of them and its links one int32 array
[n_l, width]; a vector that many rows share is one node with a list of ids. Nodes
are inserted in batches: a beam search in the graph so far and the batch itself give
the candidates, the usual rule (keep a neighbour if it is nearer to the node than to
any kept one) picks the links, links go both ways and full lists are picked again.
All steps are numpy over the whole batch.

Queries meet every shard in blocks (one row per block and shard, equi-joined on the
shard), walk down the layers and end in a beam of width ``ef``. Distances of what
they find are computed again in double precision on the original vectors, and each
query's best of all shards are kept.

Defined cases: vectors that are null, zero, or hold null or non-finite components,
and rows with a null id, take no part; a query meets only vectors of its length; rows with the query's id are its own and no
candidates; of rows that repeat a query's id the least vector asks; equal vectors
are all candidates (ties to the smaller id); fewer than k candidates give all; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm import common as C

SHARD_ROWS = 8192
LINKS = 16
EF_BUILD = 64
EF_SEARCH = 192
BATCH = 512
QUERY_BLOCK = 1024
STEP = 4


def _distances(x: np.ndarray, norms: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances (up to the query's own norm) of q[i] to x[ids[i, j]]."""
    return norms[ids] - 2 * np.matmul(x[ids], q[:, :, None])[:, :, 0]


def beam_search(x: np.ndarray, norms: np.ndarray, links: np.ndarray, n: int, q: np.ndarray,
                entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row of q the ef nearest nodes met (-1: none) and their distances,
    ascending, walking the links from the nodes ``entry`` [queries, some]."""
    m = len(q)
    row = np.arange(m)[:, None]
    seen = np.zeros((m, n + 1), bool)  # the last column takes what is not there
    ids = np.full((m, ef), -1, np.int64)
    dist = np.full((m, ef), np.inf, np.float32)
    opened = np.ones((m, ef), bool)
    w = min(entry.shape[1], ef)
    first = entry[:, :w].copy()
    for k in range(1, w):  # repeated entries count once
        first[:, k][(first[:, :k] == first[:, k:k + 1]).any(1)] = -1
    ids[:, :w] = first
    dist[:, :w] = np.where(first >= 0, _distances(x, norms, q, np.maximum(first, 0)), np.inf)
    opened[:, :w] = first < 0
    seen[row, first] = True
    order = np.argsort(dist, 1, kind="stable")
    ids, dist, opened = (np.take_along_axis(a, order, 1) for a in (ids, dist, opened))
    live = np.arange(m)
    while len(live):
        # the nearest nodes not yet opened
        closed = ~opened[live]
        some = closed.any(1)
        live = live[some]
        if not len(live):
            break
        closed = closed[some]
        pick = closed & (np.cumsum(closed, 1) <= STEP)
        opened[live] |= pick
        at = np.argsort(~pick, 1, kind="stable")[:, :STEP]
        node = np.where(np.take_along_axis(pick, at, 1), np.take_along_axis(ids[live], at, 1), -1)
        near = np.where((node >= 0)[:, :, None], links[np.maximum(node, 0)], -1).reshape(len(live), -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near]] = -1
        near = near[:, (near >= 0).any(0)]
        if not near.shape[1]:
            continue
        seen[live[:, None], near] = True
        seen[:, n] = False
        d = np.where(near >= 0, _distances(x, norms, q[live], np.maximum(near, 0)), np.inf)
        all_d = np.concatenate([dist[live], d], 1)
        best = np.argpartition(all_d, ef - 1, 1)[:, :ef]
        best_d = np.take_along_axis(all_d, best, 1)
        order = np.argsort(best_d, 1, kind="stable")
        best = np.take_along_axis(best, order, 1)
        dist[live] = np.take_along_axis(all_d, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), best, 1)
        new_open = np.concatenate([opened[live], near < 0], 1)
        opened[live] = np.take_along_axis(new_open, best, 1) | ~np.isfinite(dist[live])
    return np.where(np.isfinite(dist), ids, -1), dist


def pick_links(x: np.ndarray, node: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """Of candidates ids [nodes, k] (-1: none) at most ``width`` for each node: nearest
    first, those nearer to the node than to any kept one, then the nearest others."""
    ids = np.where(ids == node[:, None], -1, ids)
    ids = np.sort(ids, 1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    v = x[np.maximum(ids, 0)]
    d = np.where(ids >= 0, ((v - x[node][:, None, :]) ** 2).sum(2), np.inf)
    order = np.argsort(d, 1, kind="stable")
    ids, d, v = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    sq = (v ** 2).sum(2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    m, k = ids.shape
    kept = np.zeros((m, k), bool)
    nearest_kept = np.full((m, k), np.inf, np.float32)  # of each candidate to the kept ones
    count = np.zeros(m, np.int64)
    for j in range(k):
        take = (ids[:, j] >= 0) & (count < width) & (d[:, j] < nearest_kept[:, j])
        kept[:, j] = take
        count += take
        nearest_kept = np.where(take[:, None], np.minimum(nearest_kept, between[:, :, j]), nearest_kept)
    # kept ones first, then the others by distance
    order = np.argsort(np.where(ids < 0, 2, np.where(kept, 0, 1)), 1, kind="stable")[:, :width]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < width:
        out = np.concatenate([out, np.full((m, width - out.shape[1]), -1, out.dtype)], 1)
    return out


def _descend(x, norms, layers, q, ef: int = 8) -> np.ndarray:
    """Entry nodes for the layer below ``layers`` (highest first)."""
    entry = np.zeros((len(q), 1), np.int64)
    for links in layers:
        entry, _ = beam_search(x, norms, links, len(links), q, entry, ef)
    return entry[:, :4]


def build_graph(x: np.ndarray, sizes: list[int], links: int = LINKS, ef: int = EF_BUILD) -> list[np.ndarray]:
    """Layers of the graph over x (highest first); layer l holds the first sizes[l] rows."""
    norms = (x ** 2).sum(1)
    layers: list[np.ndarray] = []
    for depth, n in enumerate(sizes):
        width = 2 * links if depth == len(sizes) - 1 else links
        net = np.full((n, width), -1, np.int32)
        done = min(n, 2 * width)
        own = np.arange(done)
        net[:done] = pick_links(x, own, np.tile(own, (done, 1)), width)
        while done < n:
            stop = min(n, done + min(BATCH, done))
            own = np.arange(done, stop)
            q = x[own]
            entry = _descend(x, norms, layers, q) if layers else np.zeros((len(q), 1), np.int64)
            entry = np.where(entry < done, entry, -1)
            entry[(entry < 0).all(1), 0] = 0
            found, _ = beam_search(x, norms, net, done, q, entry, ef)
            # the nearest of the batch itself
            mates = norms[own][None, :] - 2 * q @ q.T
            k = min(links, len(own))
            mates = own[np.argpartition(mates, k - 1, 1)[:, :k]]
            net[own, :links] = pick_links(x, own, np.concatenate([found[:, :3 * links], mates], 1), links)
            # and back: every node linked to gets the new ones as candidates
            a, b = np.repeat(own, links), net[own, :links].ravel()
            a, b = a[b >= 0], b[b >= 0]
            order = np.argsort(b, kind="stable")
            a, b = a[order], b[order]
            node, begin, count = np.unique(b, return_index=True, return_counts=True)
            place = np.arange(len(b)) - np.repeat(begin, count)
            for lo in range(0, len(node), BATCH):
                part = slice(lo, lo + BATCH)
                wide = int(count[part].max())
                more = np.full((len(node[part]), wide), -1, np.int64)
                at = slice(int(begin[lo]), int(begin[part][-1] + count[part][-1]))
                more[np.repeat(np.arange(len(node[part])), count[part]), place[at]] = a[at]
                net[node[part]] = pick_links(x, node[part], np.concatenate([net[node[part]], more], 1), width)
            done = stop
        layers.append(net)
    return layers


class Shard:
    """The vectors of a shard with their graph and ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int, links: int = LINKS, ef: int = EF_BUILD):
        unique, where = np.unique(vectors, axis=0, return_inverse=True)
        where = where.ravel()
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(len(unique))) / np.log(links)).astype(int)
        order = np.argsort(-level, kind="stable")
        level = level[order]
        sizes = [int(np.count_nonzero(level >= l)) for l in range(level.max(), -1, -1)]
        self.vectors = unique[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by = np.lexsort((ids, rank[where]))
        self.ids, node = ids[by], rank[where][by]
        self.first = np.searchsorted(node, np.arange(len(unique) + 1))
        # subtracting a common point leaves distances as they are and keeps float32 precise
        self.centre = self.vectors.mean(0)
        self.layers = build_graph((self.vectors - self.centre).astype(np.float32), sizes, links, ef)

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, distance) of each query's k nearest found, own id left out."""
        x, y = (self.vectors - self.centre).astype(np.float32), (q - self.centre).astype(np.float32)
        norms = (x ** 2).sum(1)
        out = []
        for lo in range(0, len(q), BATCH):
            part = y[lo:lo + BATCH]
            entry = _descend(x, norms, self.layers[:-1], part) if len(self.layers) > 1 else np.zeros((len(part), 1), np.int64)
            found, _ = beam_search(x, norms, self.layers[-1], len(x), part, entry, max(ef, k + 1))
            for i, nodes in enumerate(found):
                nodes = nodes[nodes >= 0]
                d = np.sqrt(((self.vectors[nodes] - q[lo + i]) ** 2).sum(1))
                # of one vector's ids no more than the k smallest that are not the query's own can
                # be among the nearest; its own rows lie side by side, as a node's ids are in order
                begin, size = self.first[nodes], self.first[nodes + 1] - self.first[nodes]
                for j in np.flatnonzero(size > k):
                    left, right = (np.searchsorted(self.ids[begin[j]:begin[j] + size[j]], query_ids[lo + i], side) for side in ("left", "right"))
                    size[j] = min(size[j], k + right - left)
                ids, far = C.ragged_take(self.ids, begin, size), np.repeat(d, size)
                other = ids != query_ids[lo + i]
                ids, far = ids[other], far[other]
                best = np.lexsort((ids, far))[:k]
                out.append((np.full(len(best), query_ids[lo + i]), ids[best], far[best]))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return tuple(np.concatenate(z) for z in zip(*out))


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v: array<double>, dim) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    out = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return out.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda e: e != 0)
                     ).withColumn("dim", F.size("v"))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys of a sorted stream."""
    now, held = None, []
    for b in batches:
        cols = [C.column(b, k).to_numpy(zero_copy_only=False) for k in keys]
        edge = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0))) if b.num_rows else []
        for i, j in zip(edge, [*edge[1:], b.num_rows]):
            key = tuple(int(c[i]) for c in cols)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)


INDEX = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("dim", T.IntegerType()),
                      T.StructField("graph", T.BinaryType())])


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                shard_rows: int = SHARD_ROWS, links: int = LINKS, ef: int = EF_BUILD) -> DataFrame:
    """The index as a table: a row per shard (and vector length) with its arrays."""
    spark = vectors.sparkSession
    C.prepare(spark)
    rows = usable(vectors, id_col, vector)
    shards = max(1, -(-rows.count() // shard_rows))

    def run(batches):
        for (shard, dim), t in _groups(batches, ["shard", "dim"]):
            t = t.combine_chunks()
            graph = Shard(t.column("id").to_numpy(), _matrix(t.column("v").chunk(0)), shard, links, ef)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([dim], pa.int32()),
                                              pa.array([pickle.dumps(graph.__dict__)], pa.binary())], names=INDEX.names)

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return C.written(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "dim", "id").mapInArrow(run, INDEX))


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, ef: int = EF_SEARCH) -> DataFrame:
    """queries: (id, v, dim) as ``usable`` gives. One row per query and neighbour:
    query_id, rank from 1, vec_id, score (Euclidean distance)."""
    block_schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.BinaryType()),
                                 T.StructField("v", T.BinaryType())])
    hit = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
                        T.StructField("score", T.DoubleType())])

    def blocks(batches):
        for (_, dim), t in _groups(batches, ["block", "dim"]):
            t = t.combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([t.column("id").to_numpy().tobytes()], pa.binary()),
                 pa.array([_matrix(t.column("v").chunk(0)).tobytes()], pa.binary())], names=block_schema.names)

    def search(batches):
        held: tuple = (None, None)
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                if held[0] != (r["shard"], r["dim"]):
                    graph = Shard.__new__(Shard)
                    graph.__dict__.update(pickle.loads(r["graph"]))
                    held = ((r["shard"], r["dim"]), graph)
                ids = np.frombuffer(r["ids"], np.int64)
                got = held[1].search(ids, np.frombuffer(r["v"], np.float64).reshape(len(ids), -1), k, ef)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=hit.names)

    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.groupBy("id").agg(F.min(F.struct("v", "dim")).alias("m")).select("id", "m.v", "m.dim").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    packed = C.written(asked.repartition(n_blocks, "block").sortWithinPartitions("block", "dim", "id").mapInArrow(blocks, block_schema))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    sent = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = index.repartition(shards, "shard").join(sent.repartition(shards, "shard").hint("merge"), ["shard", "dim"])
    found = met.select("shard", "dim", "graph", "ids", "v").mapInArrow(search, hit)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = build_index(vectors)
    return search_index(index, usable(vectors, "vec_id", "embedding").where("id % 100 = 0"))
