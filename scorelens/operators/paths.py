"""I-10: tree attribution from a table of leaf paths.

A model's nodes are a table, read from what the model writes (``node_table``). Walking it
down a level a join gives every leaf's path: for each feature on it the interval that the
splits leave and the share of rows that they let through (``leaf_paths``).

A leaf pays a feature i of its path, in a row that meets (o = 1) or misses (o = 0) its
intervals, the leaf's value times (o_i - z_i) times the mean, over all orders of the other
features, of the product of o (those that came before) and z (those still to come). That
mean is the integral over u from 0 to 1 of the product of z (1 - u) + o u over the others:
a polynomial, which a few Gauss points integrate exactly. So every row meets all leaves - a
table as small as the model, its size checked - in its own task, without recursion or shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.operators.boosting import BoostedModel
from scorelens.operators.forest import ForestModel
from scorelens.plans.helpers import checkpoint
from scorelens.session import tables_root

MAX_LEAVES = 200_000  # beyond it the leaves are joined, not sent to the tasks
BLOCK = 1 << 19       # (row, leaf, step) triples that a task works on at once


def node_table(model, spark) -> DataFrame:
    """(tree, node, feature, threshold, left, right, cover, value) of every node: feature,
    left and right are -1 in leaves, rows up to the threshold go left, ``value`` has a number
    a class. Trees of a forest are to be averaged, boosted trees to be added (margins)."""
    m = model.stages[-1] if isinstance(model, PipelineModel) else model
    if isinstance(m, BoostedModel):
        k = m.numClasses
        inner = F.col("feature") >= 0
        value = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.when(c == F.col("cls"), F.col("value")).otherwise(F.lit(0.0)))
        return m.node_table(spark).select(
            (F.col("round") * k + F.col("cls")).cast("int").alias("tree"), F.col("node").cast("int").alias("node"),
            F.col("feature").cast("int").alias("feature"), "threshold",
            F.when(inner, 2 * F.col("node") + 1).otherwise(-1).cast("int").alias("left"),
            F.when(inner, 2 * F.col("node") + 2).otherwise(-1).cast("int").alias("right"),
            F.col("rows").cast("double").alias("cover"), value.alias("value"))
    if isinstance(m, ForestModel):
        return m.node_table(spark)
    import uuid
    path = f"{tables_root(spark)}/model-{uuid.uuid4().hex}"
    m.write().overwrite().save(path)
    d = spark.read.parquet(f"{path}/data")
    d = d.select(F.col("treeID").alias("tree"), "nodeData.*") if "nodeData" in d.columns else d.select(F.lit(0).alias("tree"), "*")
    if not d.where("leftChild >= 0 AND split.numCategories >= 0").isEmpty():
        raise ValueError("categorical splits are not supported")
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)
    return d.select("tree", F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"),
                    F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("leftChild").alias("left"),
                    F.col("rightChild").alias("right"), total.alias("cover"),
                    F.transform("impurityStats", lambda v: F.try_divide(v, total)).alias("value"))


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, value, path: array of (f, lo, hi, z)): a feature's interval is
    lo < x <= hi, null where it has no end; z is the share of rows let through."""
    nodes = checkpoint(nodes)
    side = lambda child, lo, hi: F.struct(F.col(child).alias("node"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    none = F.lit(None)
    edge = (nodes.where("left >= 0").select("tree", F.col("node").alias("parent"), "feature", F.col("cover").alias("whole"), F.explode(F.array(
        side("left", none, F.col("threshold")), side("right", F.col("threshold"), none))).alias("s"))
        .select("tree", "parent", "feature", "whole", "s.*")
        .join(nodes.select("tree", "node", "cover"), ["tree", "node"])
        .select("tree", F.col("parent").alias("at"), "node", F.struct(F.col("feature").alias("f"), "lo", "hi", (F.col("cover") / F.col("whole")).alias("z")).alias("step")))
    edge = checkpoint(edge)
    level = nodes.where("node = 0").select("tree", F.col("node").alias("at"), F.array().cast(f"array<{edge.schema['step'].dataType.simpleString()}>").alias("steps"))
    every = [level]
    while True:  # as many joins as the trees are deep
        level = checkpoint(level.join(edge, ["tree", "at"]).select("tree", F.col("node").alias("at"), F.concat("steps", F.array("step")).alias("steps")))
        if level.isEmpty():
            break
        every.append(level)
    walked = every[0]
    for x in every[1:]:
        walked = walked.unionByName(x)
    ends = walked.join(nodes.where("left < 0").select("tree", F.col("node").alias("at"), "value"), ["tree", "at"])
    merged = (ends.select("tree", "at", F.explode("steps").alias("s")).groupBy("tree", "at", "s.f")
                  .agg(F.max("s.lo").alias("lo"), F.min("s.hi").alias("hi"), F.product("s.z").alias("z")))
    path = merged.groupBy("tree", "at").agg(F.sort_array(F.collect_list(F.struct("f", "lo", "hi", "z"))).alias("path"))
    return checkpoint(ends.select("tree", "at", "value").join(path, ["tree", "at"], "left").select(
        "tree", F.col("at").alias("leaf"), "value", F.coalesce("path", F.array()).alias("path")))


def _paid(x: np.ndarray, groups: list, k: int) -> np.ndarray:
    """[rows, features, classes]: what the leaves pay. ``groups``: leaves with paths of one
    length as arrays (f, lo, hi, z) [leaves, steps] and value [leaves, classes]; NaN is no end."""
    out = np.zeros((*x.shape, k))
    for f, lo, hi, z, value in groups:
        m = f.shape[1]
        u, w = np.polynomial.legendre.leggauss(max((m + 1) // 2, 1))
        u, w = (u + 1) / 2, w / 2
        step = max(1, BLOCK // m)
        for a in range(0, len(f), step):
            s = slice(a, a + step)
            fs, v = f[s].ravel(), np.repeat(value[s], m, axis=0)
            order = np.argsort(fs, kind="stable")
            cuts = np.flatnonzero(np.diff(fs[order])) + 1
            rows = max(1, BLOCK // len(fs))
            for r in range(0, len(x), rows):
                at = x[r:r + rows][:, f[s]]
                # a missing value goes right, as in the models
                o = ((~(at <= lo[s])) & (np.isnan(hi[s]) | (at <= hi[s]))).astype(float)
                weight = np.zeros(at.shape)
                for uq, wq in zip(u, w):
                    factor = z[s] * (1 - uq) + o * uq
                    weight += wq * factor.prod(2, keepdims=True) / factor
                paid = ((o - z[s]) * weight).reshape(len(at), -1)
                for own in np.split(order, cuts):
                    out[r:r + rows, fs[own[0]]] += paid[:, own] @ v[own]
    return out


def _leaf_arrays(leaves: DataFrame) -> list:
    """The leaves' paths as arrays, by length; a leaf without splits pays nothing."""
    by: dict = {}
    for r in leaves.where(F.size("path") > 0).orderBy("tree", "leaf").collect():   # MAX_LEAVES at most
        by.setdefault(len(r["path"]), []).append(r)
    end = lambda rs, c: np.array([[np.nan if s[c] is None else s[c] for s in r["path"]] for r in rs])
    return [(np.array([[s["f"] for s in r["path"]] for r in rs]), end(rs, "lo"), end(rs, "hi"), end(rs, "z"), np.array([r["value"] for r in rs], float))
            for _, rs in sorted(by.items())]


def path_attribution(leaves: DataFrame, df: DataFrame, raw_features: list[str], key: str, mean: bool = True) -> DataFrame:
    """(key, cls, feature, phi, x, base_value) of every row, class and feature; ``mean``:
    trees are averaged, otherwise added. A repeated key's rows stay apart. The leaves go to
    the tasks as arrays and a row is paid by all of them in its task: nothing is shuffled."""
    shape = leaves.agg(F.max(F.size("value")), F.count_distinct("tree"), F.count(F.lit(1))).first()
    k, trees, n_leaves = shape
    share = 1.0 / trees if mean else 1.0
    whole = F.aggregate("path", F.lit(1.0), lambda a, s: a * s["z"])
    base = leaves.agg(*[(F.sum(whole * F.col("value")[c]) * share).alias(f"b{c}") for c in range(k)]).first()
    p = len(raw_features)
    x = F.array(*[F.col(f).cast("double") for f in raw_features])
    if n_leaves > MAX_LEAVES:
        rows = _joined_phi(leaves, df.select(F.col(key).alias("__key"), x.alias("__x")), k, p, share)
    else:
        groups = _leaf_arrays(leaves)

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def phi(v: pa.Array) -> pa.Array:
            at = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), p)
            return pa.ListArray.from_arrays(np.arange(0, (len(v) + 1) * p * k, p * k, dtype=np.int32), _paid(at, groups, k).ravel() * share)

        rows = df.select(F.col(key).alias("__key"), x.alias("__x")).withColumn("__phi", phi("__x"))
    names, bases = F.array(*[F.lit(f) for f in raw_features]), F.array(*[F.lit(float(base[c])) for c in range(k)])
    cells = rows.select("__key", "__x", F.posexplode("__phi").alias("__i", "phi"))
    f, c = F.expr(f"cast(__i div {k} AS int)"), F.col("__i") % k
    return cells.select(F.col("__key").alias(key), c.alias("cls"), F.get(names, f).alias("feature"), "phi",
                        F.get("__x", f).alias("x"), F.get(bases, c).alias("base_value"))


def _joined_phi(leaves: DataFrame, df: DataFrame, k: int, p: int, share: float) -> DataFrame:
    """(__key, __x, __phi) by a join of rows and leaves, for models too large for a task."""
    longest = leaves.agg(F.max(F.size("path"))).first()[0]
    rows = checkpoint(df.select(F.monotonically_increasing_id().alias("__rid"), "__key", "__x"))
    pairs = rows.crossJoin(leaves.select("path", "value"))
    at = lambda s: F.get("__x", s["f"])
    met = lambda s: (s["lo"].isNull() | (at(s) > s["lo"])) & (s["hi"].isNull() | (at(s) <= s["hi"]))
    # a missing value goes right, as in the models
    inside = lambda s: F.when(F.when(at(s).isNull(), s["hi"].isNull()).otherwise(met(s)), 1.0).otherwise(0.0)
    steps = pairs.select("__rid", "value", F.transform("path", lambda s: F.struct(s["f"].alias("f"), s["z"].alias("z"), inside(s).alias("o"))).alias("steps"))
    u, w = np.polynomial.legendre.leggauss(max((longest + 1) // 2, 1))
    u, w = (u + 1) / 2, w / 2
    factor = lambda s, v: s["z"] * float(1 - v) + s["o"] * float(v)
    product = lambda v: lambda a, s: a * factor(s, v)
    steps = steps.withColumns({f"p{q}": F.aggregate("steps", F.lit(1.0), product(v)) for q, v in enumerate(u)})
    weight = lambda s: sum((float(w[q]) * F.col(f"p{q}") / factor(s, u[q]) for q in range(len(u))), F.lit(0.0))
    paid = steps.select("__rid", "value", F.explode(F.transform("steps", lambda s: F.struct(
        s["f"].alias("f"), ((s["o"] - s["z"]) * weight(s)).alias("p")))).alias("c")).where("c.p <> 0")
    sums = paid.groupBy("__rid", F.col("c.f").alias("f")).agg(F.array(*[F.sum(F.col("c.p") * F.col("value")[c]) * share for c in range(k)]).alias("v"))
    by_row = sums.groupBy("__rid").agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("v"))   # p entries at most
    cell = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda f: F.coalesce(F.try_element_at("v", f), F.array_repeat(F.lit(0.0), k))))
    return rows.join(by_row, "__rid", "left").select("__key", "__x", cell.alias("__phi"))


def tree_attribution(model, df: DataFrame, raw_features: list[str], key: str) -> DataFrame:
    """I-10: path attribution for a tree or forest (class probabilities) or boosted trees
    (raw margins, without the initial ones)."""
    leaves = leaf_paths(node_table(model, df.sparkSession))
    return path_attribution(leaves, df, raw_features, key, mean=not isinstance(model, BoostedModel))
