"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm import common as C

EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
GOES = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])
FOREST_EDGES = 1 << 20   # edges a task holds before it reduces them
LOCAL_EDGES = 400_000    # so few edges are settled in one task


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of edges a - b, and the least node of each one's component."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[:len(a)], where[len(a):]
    root = np.arange(len(nodes))
    while len(x):
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = lo != hi
        x, y = x[apart], y[apart]
        np.minimum.at(root, hi[apart], lo[apart])
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes: each task keeps one edge a node, from
    runs of bounded length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.empty(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=EDGE.names)

        for batch in batches:
            a = np.concatenate([a, C.column(batch, "a").to_numpy()])
            b = np.concatenate([b, C.column(batch, "b").to_numpy()])
            if len(a) > FOREST_EDGES:
                a, b = _reduced(a, b)
                if 2 * len(a) > FOREST_EDGES:
                    yield out()
                    a = b = np.empty(0, np.int64)
        a, b = _reduced(a, b)
        yield out()

    return edges.select("a", "b").mapInArrow(run, EDGE)


def _reduced(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    node, root = least_nodes(a, b)
    inner = node != root
    return node[inner], root[inner]


def _settled(edges: DataFrame) -> DataFrame:
    """(node, root) of a bounded number of edges, in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(C.column(b, "a").to_numpy(), C.column(b, "b").to_numpy()) for b in batches]
        if held:
            node, root = least_nodes(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=GOES.names)

    return edges.coalesce(1).mapInArrow(run, GOES)


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long, not null); nodes of a
    component share their root, one of them. A written table.

    Every task first reduces its edges to a forest. While more than ``local_edges`` are
    left, a round of contraction follows: every node goes to the least of itself and its
    neighbours - by number in the first round, which settles stars around a least node,
    then by a hash, another one each round, so that chains shrink by a factor, too - and
    the edges between what is left go on. The minimum over a hub's many edges is
    combined on the map side; the joins that follow a hub are skew joins. The bounded
    number of edges that is left in the end is settled in one task.
    """
    left = C.written(spanning_forest(edges.where("a <> b")))
    maps: list[DataFrame] = []
    while left.count() > local_edges:
        turn = len(maps)
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        by = (lambda c: F.xxhash64(F.col(c), F.lit(turn))) if turn else F.col  # noqa: B023
        rank = lambda c: F.struct(by(c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        near = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        goes = C.written(near.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["n"].alias("root")))
        maps.append(goes)
        step = C.keyed_join(left, goes.select(F.col("node").alias("a"), F.col("root").alias("ra")), ["a"])
        step = C.keyed_join(step, goes.select(F.col("node").alias("b"), F.col("root").alias("rb")), ["b"])
        step = step.select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct()
        left = C.written(spanning_forest(step))
    out = C.written(_settled(left))
    for goes in reversed(maps):
        # a round's targets that have no edge left are roots
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = C.written(goes.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")))
    return out
