"""Feature preparation and selection.

Fitted statistics (means, medians, levels, class sizes) are one aggregate
whose size is bounded by the number of columns / levels / classes, joined back
by broadcast. Splits are exact (a global order by a seeded md5 of the key, cut
at a computed count): the cut is selected from counts by hash interval, then
filtered by, so that rows are not sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.operators import stats
from scorelens.plans.helpers import to_long
from scorelens.plans.rank import nth_rows, row_position


# ---------------------------------------------------------------- imputation
def _modes(long: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    """One row: the most frequent value (the smallest on ties) of every feature of a long
    table (feature, value), from counts by value: no task holds a column's values."""
    n = long.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("m"))
    return F.broadcast(best.agg(*[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(f"{prefix}{c}") for c in cols]))


def impute_stat(df: DataFrame, cols: list[str], strategy: str = "median", approx: bool = False) -> DataFrame:
    """P-01: fill NULL numeric cells with the column mean / median / most frequent."""
    fns = {"mean": lambda c: F.avg(c),
           "median": lambda c: F.percentile_approx(c, 0.5, 10000)}
    if strategy == "median" and not approx:
        # exact medians from the distributed running count (no column held in one task)
        from scorelens.operators.profile import quantile_table
        q = quantile_table(to_long(df, cols), ["feature"], "value", [0.5])
        fill = F.broadcast(q.agg(*[F.max(F.when(F.col("feature") == c, F.col("_q")[0])).alias(f"__f_{c}")
                                   for c in cols]))           # one row
    elif strategy == "most_frequent":
        fill = _modes(to_long(df, cols), cols, "__f_")
    else:
        fill = F.broadcast(df.agg(*[fns[strategy](F.col(c).cast("double")).alias(f"__f_{c}") for c in cols]))
    j = df.crossJoin(fill)   # one row
    return j.select(*[F.coalesce(F.col(c).cast("double"), F.col(f"__f_{c}")).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def impute_mode_cat(df: DataFrame, cols: list[str], fallback: str = "Unknown") -> DataFrame:
    """P-02: fill NULL categories with the most frequent level (smallest on
    ties, N8); a column with no value at all gets ``fallback``."""
    long = df.select(*[F.col(c).cast("string") for c in cols]).unpivot([], cols, "feature", "value")
    j = df.crossJoin(_modes(long, cols, "__m_"))   # one row
    return j.select(*[F.coalesce(F.col(c), F.col(f"__m_{c}"), F.lit(fallback)).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


# ------------------------------------------------------------------ encoding
def label_encode(df: DataFrame, cols: list[str], suffix: str = "_code") -> DataFrame:
    """P-04: sorted, 0-based code per level (LabelEncoder order, N9).

    Levels are ranked with the distributed running count over the distinct
    (column, level) table, then joined back (AQE broadcasts a small level table)."""
    out = df
    for c in cols:
        lv = df.select(F.col(c).cast("string").alias("level")).where(F.col("level").isNotNull()).distinct()
        codes = row_position(lv, ["level"], out=f"{c}{suffix}").select("level", F.col(f"{c}{suffix}").cast("int"))
        out = out.join(codes, out[c].cast("string") == codes["level"], "left").drop("level")
    return out


def target_index(df: DataFrame, target: str, out: str = "label_index") -> DataFrame:
    """P-06: class -> 0..K-1 in sorted class order."""
    return label_encode(df, [target], suffix="__idx").withColumnRenamed(f"{target}__idx", out)


def one_hot(df: DataFrame, col_: str, levels: list | None = None, prefix: str | None = None,
            drop_source: bool = True, max_levels: int = 1000) -> DataFrame:
    """P-05: one 0/1 column per level (all levels kept; unknown level -> all zeros).

    Levels are fitted on the data when not given (a distinct over one column,
    bounded by its cardinality)."""
    if levels is None:
        # a one-hot column per level only makes sense for a bounded level set:
        # fetch at most max_levels + 1 distinct values and refuse beyond that
        found = df.select(col_).where(F.col(col_).isNotNull()).distinct().limit(max_levels + 1).collect()
        if len(found) > max_levels:
            raise ValueError(f"{col_} has more than {max_levels} levels; use label_encode instead")
        levels = sorted(r[0] for r in found)
    prefix = prefix or f"{col_}__"
    cols = [F.when(F.col(col_) == F.lit(v), 1).otherwise(0).alias(f"{prefix}{v}") for v in levels]
    res = df.select("*", *cols)
    return res.drop(col_) if drop_source else res


def standard_scale(train: DataFrame, cols: list[str], apply_to: DataFrame | None = None) -> DataFrame:
    """P-07: (x - mean) / population std, fitted on ``train`` (sklearn semantics,
    N4); a zero std divides by 1."""
    st = F.broadcast(train.agg(*[F.avg(F.col(c).cast("double")).alias(f"__m_{c}") for c in cols],
                               *[F.stddev_pop(F.col(c).cast("double")).alias(f"__s_{c}") for c in cols]))
    target = apply_to if apply_to is not None else train
    j = target.crossJoin(st)
    return j.select(*[((F.col(c) - F.col(f"__m_{c}")) /
                       F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))).alias(c)
                      if c in cols else F.col(c) for c in target.columns])


def balanced_class_weight(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """P-19: n / (K * n_c) per class, joined back as a weight column."""
    c = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("__nc"))
    w = c.select(target, (F.sum("__nc").over(Window.partitionBy(F.lit(1))) /
                          (F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) * F.col("__nc"))).alias(out))
    return df.join(F.broadcast(w), target, "left")   # one row per class


def class_weights(df: DataFrame, target: str) -> DataFrame:
    c = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    wall = Window.partitionBy(F.lit(1))
    return c.select(target, "n", (F.sum("n").over(wall) / (F.count(F.lit(1)).over(wall) * F.col("n"))).alias("weight"))


# -------------------------------------------------------------------- splits
def _hash_key(key_cols: list[str], seed: int):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key_cols]))


def _first_by_hash(df: DataFrame, key_cols: list[str], seed: int, take: DataFrame, groups: list[str], out: str) -> DataFrame:
    """Rows up to the ``__k``-th of their group in (md5, key) order are 'test'. ``take`` is
    (groups, ``__k``), one row per class.

    One aggregation counts the rows of each of 4,096 hash intervals; only the rows of the
    interval that holds the cut (n / 4,096 of a class) are ranked. The rest is a filter:
    the rows themselves are neither sorted nor shuffled."""
    h = df.withColumn("__h", _hash_key(key_cols, seed)).withColumn("__b", F.substring("__h", 1, 3))
    n = h.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"))
    n = n.join(F.broadcast(take), groups) if groups else n.crossJoin(F.broadcast(take))
    w = Window.partitionBy(*(groups or [F.lit(1)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("__to", F.sum("__n").over(w))                       # at most 4,096 rows a class
    at = n.where((F.col("__to") >= F.col("__k")) & (F.col("__to") - F.col("__n") < F.col("__k"))).select(
        *groups, F.col("__b").alias("__cb"), (F.col("__k") - F.col("__to") + F.col("__n")).alias("__nth"))
    narrow = h.select(*groups, *[k for k in key_cols if k not in groups], "__h", "__b")
    near = narrow.join(F.broadcast(at), groups) if groups else narrow.crossJoin(F.broadcast(at))
    order = ["__h", *key_cols]
    cut = nth_rows(near.where("__b = __cb").drop("__b", "__cb"), order, groups, "__nth")
    # a class that takes no row has no cut: all its rows are 'train'
    j = h.join(F.broadcast(cut), groups, "left") if groups else h.join(F.broadcast(cut), F.lit(True), "left")
    upto = F.struct(*[F.col(o).alias(f"c{i}") for i, o in enumerate(order)]) <= F.struct(
        *[F.col(f"__c{i}").alias(f"c{i}") for i in range(len(order))])
    return j.withColumn(out, F.when(F.col("__c0").isNotNull() & upto, "test").otherwise("train")).drop(
        "__h", "__b", *[f"__c{i}" for i in range(len(order))])


def split_random(df: DataFrame, key_cols: list[str], test_frac: float = 0.2, seed: int = 42,
                 out: str = "split") -> DataFrame:
    """P-09: exact-share random split: the ceil(t * n) rows first in md5(seed|key)
    order are 'test'. The key must identify rows (rows that share one stay together)."""
    take = df.agg(F.ceil(F.count(F.lit(1)) * F.lit(float(test_frac))).alias("__k"))
    return _first_by_hash(df, key_cols, seed, take, [], out)


def split_stratified(df: DataFrame, key_cols: list[str], target: str, test_frac: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """P-10: exact stratified split. n_test = ceil(t * n) is spread over the
    classes by largest remainder (ties: class order), then every class takes its
    first rows in md5 order. Rows without a class are left out."""
    h = df.where(F.col(target).isNotNull())
    cc = h.groupBy(target).agg(F.count(F.lit(1)).alias("__nc"))
    wall = Window.partitionBy(F.lit(1))
    n = F.sum("__nc").over(wall)
    ntest = F.ceil(n * F.lit(float(test_frac)))
    exact = ntest * F.col("__nc") / n
    alloc = cc.select(target, "__nc", F.floor(exact).alias("__base"), (exact - F.floor(exact)).alias("__rem"),
                      ntest.alias("__ntest"))
    alloc = alloc.select("*", (F.col("__ntest") - F.sum("__base").over(wall)).alias("__left"),
                         F.row_number().over(wall.orderBy(F.col("__rem").desc(), F.col(target))).alias("__rr"))
    alloc = alloc.select(target, (F.col("__base") + F.when(F.col("__rr") <= F.col("__left"), 1).otherwise(0))
                         .alias("__k"))                                  # one row per class
    return _first_by_hash(h, key_cols, seed, alloc, [target], out)


def split_time(df: DataFrame, time_col: str, key_cols: list[str], test_frac: float = 0.2,
               out: str = "split") -> DataFrame:
    """P-11: sort by (time, key); the first int(n * (1 - t)) rows are 'train'."""
    share = 1.0 - float(test_frac)
    marks = [min(max(share + d, 0.0), 1.0) for d in (-2e-4, 2e-4)]
    order = [time_col, *key_cols]
    narrow = df.select(*order)
    t = F.col(time_col)
    near = F.broadcast(narrow.agg(F.percentile_approx(time_col, marks, 10000).alias("__near")))   # one row
    x = narrow.crossJoin(near)
    before = t.isNull() | (t < F.col("__near")[0])
    inside = t.between(F.col("__near")[0], F.col("__near")[1])
    n, below, held = x.agg(F.count(F.lit(1)), F.coalesce(F.sum(before.cast("long")), F.lit(0)),
                           F.coalesce(F.sum(inside.cast("long")), F.lit(0))).first()
    k = math.floor(n * share)
    if not k:
        return df.withColumn(out, F.lit("test"))
    # the sketch names the times near the cut; where it errs all rows are ranked
    near_rows, nth = (x.where(inside), k - below) if below < k <= below + held else (narrow, k)
    cut = nth_rows(near_rows.withColumn("__nth", F.lit(nth)), order, [], "__nth")
    upto = F.struct(*[F.col(o).alias(f"c{i}") for i, o in enumerate(order)]) <= F.struct(
        *[F.col(f"__c{i}").alias(f"c{i}") for i in range(len(order))])
    return df.crossJoin(F.broadcast(cut)).withColumn(out, F.when(upto, "train").otherwise("test")).drop(
        *[f"__c{i}" for i in range(len(order))])


# ----------------------------------------------------------------- selection
def select_mi_or_corr(df: DataFrame, features: list[str], target: str, r_cut: float = 0.15,
                      bins: int = 10) -> DataFrame:
    """P-12: keep a feature when MI >= mean MI or |r| >= r_cut (detail table)."""
    mi = stats.mutual_information(df, features, target, bins)
    r = stats.corr_with_target(df, features, target).select("feature", "abs_r")
    j = mi.join(r, "feature", "full_outer")
    mean_mi = F.avg("mi").over(Window.partitionBy(F.lit(1)))
    j = j.select("feature", "mi", "abs_r", (F.col("mi") >= mean_mi).alias("by_mi"),
                 (F.col("abs_r") >= r_cut).alias("by_corr"))
    return j.withColumn("selected", F.coalesce("by_mi", F.lit(False)) | F.coalesce("by_corr", F.lit(False)))


def select_k_best_mi(df: DataFrame, features: list[str], target: str, k: int = 25, bins: int = 10) -> DataFrame:
    """P-13: the k features with the highest MI (ties: name)."""
    mi = stats.mutual_information(df, features, target, bins)
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("mi").desc(), "feature")
    return mi.select("feature", "mi", F.row_number().over(w).cast("long").alias("mi_rank")).where(F.col("mi_rank") <= k)


def select_mi_decorrelate(df: DataFrame, features: list[str], target: str, top_n: int = 20,
                          r_cut: float = 0.9, bins: int = 10) -> DataFrame:
    """P-14: MI top N, then greedily keep a feature unless |r| >= r_cut with a
    feature kept before it. MI and the N x N correlation matrix are Spark jobs;
    the greedy pass runs on the driver over that bounded matrix (N <= p)."""
    spark = df.sparkSession
    top = select_k_best_mi(df, features, target, top_n, bins).orderBy("mi_rank").collect()
    names = [r["feature"] for r in top]
    mat = {(r["var1"], r["var2"]): r["r"] for r in stats.pearson_matrix(df, names).collect()}
    kept: list[str] = []
    rows = []
    for r in top:
        f = r["feature"]
        clash = next((k for k in kept if mat.get((f, k)) is not None and abs(mat[(f, k)]) >= r_cut), None)
        if clash is None:
            kept.append(f)
        rows.append((f, float(r["mi"]), int(r["mi_rank"]), clash is None, clash))
    return spark.createDataFrame(rows, "feature string, mi double, mi_rank long, kept boolean, dropped_for string")


def select_manual(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """P-15: user-chosen feature columns (plus kept id / target columns)."""
    return df.select(*(keep or []), *cols)


# ----------------------------------------------------------------- pipelines
class PreprocessPipeline:
    """P-08: median impute + standard scale (population std) of numeric columns,
    one-hot of categories (all levels, an unknown level or NULL -> zeros), as one
    vector column. ``fit`` learns exact medians, moments and levels from the rows it
    gets; a column with more than ``max_levels`` levels is refused."""

    def __init__(self, numeric: list[str], categorical: list[str], out: str = "features", max_levels: int = 1000):
        self.numeric, self.categorical, self.out, self.max_levels = numeric, categorical, out, max_levels

    def fit(self, train: DataFrame) -> "PreprocessModel":
        medians: dict = {c: None for c in self.numeric}
        if self.numeric:
            from scorelens.plans.rank import exact_quantiles
            q = exact_quantiles(to_long(train, self.numeric), ["feature"], "value", [0.5]).collect()  # one row per column
            medians |= {r["feature"]: r["q"] for r in q}
        medians = {c: 0.0 if m is None else float(m) for c, m in medians.items()}   # a column without values
        x = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in self.numeric}
        row = train.agg(F.count(F.lit(1)), *[f(x[c]) for c in self.numeric for f in (F.avg, F.stddev_pop)]).first()
        moments = {c: (row[1 + 2 * i] or 0.0, row[2 + 2 * i] or 1.0) for i, c in enumerate(self.numeric)}
        levels = {}
        for c in self.categorical:
            got = train.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().limit(self.max_levels + 1).collect()
            if len(got) > self.max_levels:
                raise ValueError(f"{c} has more than {self.max_levels} levels")
            levels[c] = sorted(r[0] for r in got)
        return PreprocessModel(self, medians, moments, levels)


class PreprocessModel:
    """A fitted ``PreprocessPipeline``; ``names`` are the vector's slots."""

    def __init__(self, pipe: PreprocessPipeline, medians: dict, moments: dict, levels: dict):
        self.pipe, self.medians, self.moments, self.levels = pipe, medians, moments, levels
        self.names = [f"num__{c}" for c in pipe.numeric] + [f"cat__{c}_{v}" for c in pipe.categorical for v in levels[c]]

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector
        slots = [(F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - self.moments[c][0]) / F.lit(self.moments[c][1])
                 for c in self.pipe.numeric]
        slots += [F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0))
                  for c in self.pipe.categorical for v in self.levels[c]]
        return df.withColumn(self.pipe.out, array_to_vector(F.array(*slots)))


def preprocess_pipeline(numeric: list[str], categorical: list[str], out: str = "features") -> PreprocessPipeline:
    """P-08: the unfitted pipeline of ``PreprocessPipeline``."""
    return PreprocessPipeline(numeric, categorical, out)
