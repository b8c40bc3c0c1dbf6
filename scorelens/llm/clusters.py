"""Links within clusters: groups of sets that no link leaves, each compared by one task
or, if it is large, by many.

A small cluster is compared as a whole. A large one is dealt in chunks over many tasks:
each compares its members with the same few *pivots*. Members that meet in a component
need no comparison with each other; as long as a cluster has members in different
components that have not been compared, members outside its largest component become
the next pivots, each compared with all. So a huge group of near copies takes work in
proportion to its size, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm import common as C
from scorelens.llm.components import EDGE, components


class Limits(NamedTuple):
    """What a task holds at most; links do not depend on it."""

    small: int = 256          # members of a cluster that one task compares
    chunk: int = 192          # members of a large cluster in one task
    pivots: int = 96          # members that all others are compared with, first round
    more: int = 1024          # and in later rounds
    weight: int = 2 << 20     # set elements of a small cluster, of a chunk, and of pivots


Members = list[tuple[int, np.ndarray]]
# links among the members (pivots: None), or between members and pivots, that connect
# all that any links connect
Compare = Callable[[Members, Members | None], list[tuple[int, int]]]


def _compared(rows: DataFrame, compare: Compare, parts: int) -> DataFrame:
    """Edges of every (cluster, chunk) of rows (cluster, chunk, role, __rid, seq); the
    role is 0 in a small cluster, 1 for members and 2 for pivots of a large one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])

        def links():
            got = compare(held[0], None) if held[0] else compare(held[1], held[2]) if held[1] and held[2] else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())],
                                              names=EDGE.names)

        for batch in batches:
            for c, k, role, rid, seq in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (c, k) != now:
                    if now is not None:
                        yield links()
                    now, held = (c, k), ([], [], [])
                held[role].append((rid, np.frombuffer(seq, "<u8")))
        if now is not None:
            yield links()

    dealt = rows.select("cluster", "chunk", "role", "__rid", "seq").repartition(parts, "cluster", "chunk")
    return dealt.sortWithinPartitions("cluster", "chunk", "__rid").mapInArrow(run, EDGE)


def _some(most: int, of, weight, limits: Limits):
    """How many of ``of`` members: at most ``most``, and by their mean weight not beyond half the limit."""
    return F.greatest(F.least(F.lit(most), F.floor(of * F.lit(limits.weight / 2) / weight)), F.lit(1))


def cluster_links(sets: DataFrame, clusters: DataFrame, compare: Compare, limits: Limits, parts: int) -> DataFrame:
    """(a, b): all edges that the components need, from sets (__rid, n, seq: n elements
    of 8 bytes) and clusters (__rid, cluster)."""
    small = (F.col("size") <= limits.small) & (F.col("weight") <= limits.weight)
    placed = C.written(clusters.join(sets.select("__rid", "n").hint("merge"), "__rid"))
    size = C.written(placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")))
    first = F.pmod(F.xxhash64("__rid"), F.col("size")) < _some(limits.pivots, F.col("size"), F.col("weight"), limits)
    state = C.keyed_join(placed, size, ["cluster"]).select(
        "__rid", "cluster", "size", "weight", F.when(small, 0).when(first, 2).otherwise(1).alias("role"))
    edges, turn = None, 0
    while True:
        state = C.written(state)
        chunks = F.when(F.col("role") == 0, 1).otherwise(F.ceil(F.greatest(
            F.col("size") / limits.chunk, 2 * F.col("weight") / limits.weight))).cast("int")
        full = state.join(sets.select("__rid", "seq").hint("merge"), "__rid").withColumn("chunks", chunks)
        members = full.withColumn("chunk", F.pmod(F.xxhash64("__rid", F.lit(1)), F.col("chunks")).cast("int"))
        members = members.withColumn("role", F.least("role", F.lit(1)))
        pivots = full.where("role = 2").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        names = ["cluster", "chunk", "role", "__rid", "seq"]
        found = C.written(_compared(members.select(names).unionByName(pivots.select(names)), compare, parts))
        edges = found if edges is None else C.written(edges.unionByName(found))
        # large clusters whose remaining members lie in several components go on
        rest = state.where("role = 1").select("__rid", "cluster")
        if rest.isEmpty():
            return edges
        edges = components(edges).select(F.col("node").alias("a"), F.col("root").alias("b"))
        rest = C.written(rest.join(placed.select("__rid", "n").hint("merge"), "__rid").join(
            edges.withColumnsRenamed({"a": "__rid", "b": "root"}).hint("merge"), "__rid", "left")
            .select("__rid", "cluster", "n", F.coalesce("root", "__rid").alias("root")))
        per = rest.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
        open_ = C.written(per.groupBy("cluster").agg(
            F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("size"), F.sum("w").alias("weight"),
            F.count(F.lit(1)).alias("roots")).where("roots > 1").select(
                "cluster", "size", "weight", F.col("top.root").alias("main"), (F.col("size") - F.col("top.k")).alias("others")))
        if open_.isEmpty():
            return edges
        turn += 1
        next_ = ((F.col("root") != F.col("main")) & (F.pmod(F.xxhash64("__rid", F.lit(turn)), F.col("others"))
                 < _some(limits.more, F.col("size"), F.col("weight"), limits)))
        state = C.keyed_join(rest, open_, ["cluster"]).select(
            "__rid", "cluster", "size", "weight", F.when(next_, 2).otherwise(1).alias("role"))
