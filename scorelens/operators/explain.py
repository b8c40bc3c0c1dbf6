"""Importance, attribution and their summaries.

The attribution table is long: ``(row_id, cls, feature, phi, x)``. Every
summary is a groupBy over it (partial aggregation); per-row views use windows
partitioned by (row, class), whose size is the number of features.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.operators import profile, stats
from scorelens.plans.helpers import checkpoint, to_long

def _wall():
    """Window over a small per-feature table (built lazily: no session on executors)."""
    return Window.partitionBy(F.lit(1))


# ----------------------------------------------------------- importance tables
def consensus_importance(imp: DataFrame, feature: str = "feature", model: str = "model", value: str = "value",
                         top: int = 30) -> DataFrame:
    """I-04: each model's importances sum-normalised, averaged over models,
    top ``top`` as a percentage share."""
    tot = F.sum(value).over(Window.partitionBy(model))
    n = imp.select(feature, model, (F.col(value) / (tot + 1e-12)).alias("share"))
    c = n.groupBy(feature).agg(F.avg("share").alias("consensus"), F.count(F.lit(1)).alias("n_models"))
    w = _wall().orderBy(F.col("consensus").desc(), F.col(feature))
    return (c.select(feature, "consensus", (F.col("consensus") * 100).alias("share_pct"), "n_models",
                     F.row_number().over(w).cast("long").alias("rank"))
             .where(F.col("rank") <= top))


def ensemble_rank(scores: DataFrame, score_cols: list[str], feature: str = "feature", eps: float = 1e-12) -> DataFrame:
    """I-05: min-max each score over features, mean of the normalised scores, rank."""
    cols = []
    for c in score_cols:
        lo, hi = F.min(c).over(_wall()), F.max(c).over(_wall())
        cols.append(((F.col(c) - lo) / (hi - lo + eps)).alias(f"n_{c}"))
    n = scores.select(feature, *cols)
    mean = sum((F.col(f"n_{c}") for c in score_cols), F.lit(0.0)) / float(len(score_cols))
    n = n.withColumn("ensemble_score", mean)
    return n.withColumn("rank", F.row_number().over(_wall().orderBy(F.col("ensemble_score").desc(), F.col(feature)))
                        .cast("long"))


def top_bottom_groups(scores: DataFrame, score: str, top: int = 20, bottom: int = 15,
                      feature: str = "feature") -> DataFrame:
    """I-06: label features 'top' / 'bottom' / 'middle' by rank of ``score``."""
    r = scores.select(feature, score,
                      F.row_number().over(_wall().orderBy(F.col(score).desc(), F.col(feature))).cast("long").alias("rank"),
                      F.count(F.lit(1)).over(_wall()).alias("_n"))
    grp = (F.when(F.col("rank") <= top, "top")
            .when(F.col("rank") > F.col("_n") - bottom, "bottom").otherwise("middle"))
    return r.select(feature, score, "rank", grp.alias("grp"))


def important_vs_rest_profile(df: DataFrame, features: list[str], important: list[str]) -> DataFrame:
    """I-07: column-shape statistics of important vs other columns, compared
    per statistic with Welch's t (statistic and df)."""
    shp = profile.column_shape_stats(df, features)
    flag = shp.withColumn("grp", F.when(F.col("feature").isin(important), "top").otherwise("rest"))
    long = to_long(flag, ["missing_rate", "cv", "iqr", "outlier_rate", "skew"], ["feature", "grp"], name="stat")
    return stats.welch_t(long, "value", "grp", "top", by=["stat"], with_p=False)


def spearman_small(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman rho between two columns of a per-feature table (bounded size)."""
    def ar(c):
        return (F.rank().over(_wall().orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2.0)
    r = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(ar(a).alias("ra"), ar(b).alias("rb"))
    return r.agg(F.try_divide(F.covar_samp("ra", "rb"), F.stddev_samp("ra") * F.stddev_samp("rb")).alias("rho"),
                 F.count(F.lit(1)).alias("n"))


def importance_vs_separation(ens: DataFrame, kw: DataFrame, feature: str = "feature") -> DataFrame:
    """I-08: ensemble score next to eta^2 per feature, with their Spearman rho."""
    j = ens.select(feature, "ensemble_score").join(kw.select(feature, "eta2"), feature)
    rho = spearman_small(j, "ensemble_score", "eta2")
    return j.crossJoin(F.broadcast(rho))    # rho is one row


# ------------------------------------------------------------------ attribution
def linear_attribution(df: DataFrame, coef: dict, features: list[str], row_id: str,
                       background: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """I-09: phi = coef[class][feature] * (x - background mean of the feature).

    ``coef`` maps class -> {feature: weight}; it is a small parameter table
    (classes x features) broadcast to the rows. Decimal background columns are summed
    exactly, so that their means do not depend on the order of the rows. ``keep``: further
    columns of ``df`` that follow every cell."""
    keep = keep or []
    spark = df.sparkSession
    bg = (background if background is not None else df)

    def mean(f):
        if isinstance(bg.schema[f].dataType, T.DecimalType):
            return F.try_divide(F.sum(f).cast("double"), F.count(f))
        return F.avg(F.col(f).cast("double"))

    means = F.broadcast(bg.agg(*[mean(f).alias(f) for f in features]).select(
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mu")) for f in features]))))
    ct = F.broadcast(spark.createDataFrame([(int(k), f, float(w)) for k, fw in coef.items() for f, w in fw.items()],
                                           "cls int, feature string, coef double"))
    long = to_long(df, features, [row_id, *keep], name="feature", value="x")
    return (long.join(means, "feature").join(ct, "feature")
                .select(row_id, "cls", "feature", (F.col("coef") * (F.col("x") - F.col("mu"))).alias("phi"), "x", *keep))


def attribution_rows(df: DataFrame, coef: dict, features: list[str], row_id: str, background: DataFrame | None = None,
                     keep: list[str] | None = None) -> DataFrame:
    """I-09 row by row: (row_id, kept columns, x: one number a feature, phi: class -> one
    number a feature). What follows stays inside the row: nothing is shuffled."""
    bg = background if background is not None else df
    mean = lambda f: (F.try_divide(F.sum(f).cast("double"), F.count(f)) if isinstance(bg.schema[f].dataType, T.DecimalType)
                      else F.avg(F.col(f).cast("double")))
    means = bg.agg(F.array(*[mean(f) for f in features]).alias("__mu"))
    x = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    rows = df.select(F.col(row_id), *(keep or []), x).crossJoin(F.broadcast(means))   # one row
    weights = lambda fw: F.array(*[F.lit(float(fw[f])) for f in features])
    phi = lambda fw: F.transform(F.arrays_zip(weights(fw).alias("w"), F.col("x"), F.col("__mu").alias("m")),
                                 lambda e: e["w"] * (e["x"] - e["m"]))
    by_class = F.create_map(*[v for k, fw in sorted(coef.items()) for v in (F.lit(int(k)), phi(fw))])
    return rows.select(row_id, *(keep or []), "x", by_class.alias("phi"))


def waterfall_rows(rows: DataFrame, features: list[str], cls: str, row_id: str, top: int = 10) -> DataFrame:
    """I-15 from ``attribution_rows``: a row's ``top`` features by |phi| for the class in
    column ``cls``, with running totals, ordered and cut inside the row."""
    names = F.array(*[F.lit(f) for f in features])
    each = F.transform(F.try_element_at(F.col("phi"), F.col(cls)), lambda v, i: F.struct(
        v.isNull().alias("none"), (-F.abs(v)).alias("m"), F.get(names, i).alias("feature"), v.alias("phi")))
    cut = rows.select(row_id, F.col(cls).alias("cls"), F.slice(F.array_sort(each), 1, top).alias("l"))
    steps = F.transform("l", lambda e, i: F.struct(e["feature"].alias("feature"), e["phi"].alias("phi"), (i + 1).alias("step"), F.aggregate(
        F.slice("l", F.lit(1), i + 1), F.lit(0.0), lambda a, b: a + F.coalesce(b["phi"], F.lit(0.0))).alias("cum_phi")))
    return cut.select(row_id, "cls", F.inline(steps))


def points_rows(rows: DataFrame, features: list[str], row_id: str, top: int = 15) -> DataFrame:
    """I-16 from ``attribution_rows``: phi summed over classes and min-max scaled values of
    the ``top`` features by mean |sum|; bounds and means are one aggregation."""
    k = len(features)
    total = F.aggregate(F.map_values("phi"), F.array_repeat(F.lit(0.0), k), lambda a, v: F.zip_with(a, v, lambda p, q: p + q))
    r = rows.select(row_id, "x", total.alias("s"))
    stats_ = r.agg(*[f(c) for i in range(k) for f, c in ((F.avg, F.abs(F.col("s")[i])), (F.min, F.col("x")[i]), (F.max, F.col("x")[i]))]).first()
    own = [(features[i], i, *stats_[3 * i:3 * i + 3]) for i in range(k)]   # one row of bounded width
    best = sorted(own, key=lambda o: (-(o[2] if o[2] is not None else -1.0), o[0]))[:top]
    points = [F.struct(F.lit(f).alias("feature"), F.col("s")[i].alias("phi_sum"),
                       ((F.col("x")[i] - F.lit(lo)) / F.lit(None if lo is None else hi - lo + 1e-12)).alias("x_scaled")) for f, i, _, lo, hi in best]
    return r.select(row_id, F.inline(F.array(*points)))


def attribution_summary(attr: DataFrame) -> DataFrame:
    """I-11: mean |phi| over class x row, mean signed phi, direction label."""
    s = attr.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"), F.avg("phi").alias("mean_phi"))
    return s.withColumn("direction", F.when(F.col("mean_phi") > 0, "positive")
                        .when(F.col("mean_phi") < 0, "negative").otherwise("neutral")) \
            .orderBy(F.col("mean_abs_phi").desc(), "feature")


def attribution_class_matrix(attr: DataFrame, top: int = 12) -> DataFrame:
    """I-12: class x top features mean phi (long form); top by mean |phi|. The cells are
    added up once, by class and feature; what follows is over that small table."""
    c = attr.groupBy("cls", "feature").agg(F.avg("phi").alias("mean_phi"), F.sum(F.abs("phi")).alias("_a"), F.count("phi").alias("_n"))
    w = Window.partitionBy("feature")
    c = c.withColumn("_m", F.try_divide(F.sum("_a").over(w), F.sum("_n").over(w)))
    r = c.withColumn("_r", F.dense_rank().over(_wall().orderBy(F.col("_m").desc(), "feature")))
    return r.where((F.col("_r") <= top) & F.col("feature").isNotNull()).select("cls", "feature", "mean_phi")


def attribution_direction(attr: DataFrame, target_class, weak_frac: float = 0.05, top: int = 35) -> DataFrame:
    """I-13: target class only: mean |phi|, mean phi; 'weak' when mean |phi| is
    below weak_frac x the p75 of the positive mean |phi| values; top ``top``."""
    s = (attr.where(F.col("cls") == target_class).groupBy("feature")
             .agg(F.avg(F.abs("phi")).alias("mean_abs_phi"), F.avg("phi").alias("mean_phi")))
    p75 = s.where(F.col("mean_abs_phi") > 0).agg(F.percentile("mean_abs_phi", 0.75).alias("p75"))
    j = s.crossJoin(F.broadcast(p75))
    thr = F.coalesce(F.col("p75"), F.lit(0.0)) * weak_frac
    lab = (F.when(F.col("mean_abs_phi") < thr, "weak").when(F.col("mean_phi") > 0, "raises")
            .when(F.col("mean_phi") < 0, "lowers").otherwise("weak"))
    r = j.select("feature", "mean_abs_phi", "mean_phi", lab.alias("label"),
                 F.row_number().over(_wall().orderBy(F.col("mean_abs_phi").desc(), "feature")).cast("long").alias("rank"))
    return r.where(F.col("rank") <= top)


def attribution_dependence(attr: DataFrame, feature: str) -> DataFrame:
    """I-14: trend of phi on the feature value per class (the (x, phi) pairs
    themselves are ``attr`` filtered to the feature)."""
    return stats.linear_trend(attr.where(F.col("feature") == feature), "x", "phi", ["cls"])


def attribution_waterfall(attr: DataFrame, row_id: str, k: int = 10, cls_of_row: DataFrame | str | None = None) -> DataFrame:
    """I-15: per (row, class): top k features by |phi| and the running total,
    for all rows at once (window size = number of features). ``cls_of_row`` restricts
    every row to one class (e.g. its label): a table (row_id, cls), or the name of a column
    that ``attr`` carries, by which cells are dropped before anything is shuffled."""
    if isinstance(cls_of_row, str):
        a = _own_cells(attr, row_id, cls_of_row)
    else:
        a = attr.join(cls_of_row, [row_id, "cls"], "left_semi") if cls_of_row is not None else attr
    w = Window.partitionBy(row_id, "cls").orderBy(F.abs("phi").desc(), F.col("feature"))
    r = a.select(row_id, "cls", "feature", "phi", F.row_number().over(w).alias("step"))
    r = r.where(F.col("step") <= k)
    return r.withColumn("cum_phi", F.sum("phi").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
            .withColumn("step", F.col("step").cast("long"))


def _own_cells(attr: DataFrame, row_id: str, own: str) -> DataFrame:
    """Cells whose (row_id, cls) is some row's (row_id, class in column ``own``). A key
    with one class needs no join for it, only a filter; keys that repeat with several
    classes, or with and without one, are found first and joined."""
    mine = attr.where((F.col("cls") == F.col(own)) & F.col(row_id).isNotNull())
    c = attr.groupBy(row_id).agg(F.min(own).alias("__lo"), F.max(own).alias("__hi"), (F.count(own) < F.count(F.lit(1))).alias("__gap"))
    mixed = checkpoint(c.where((F.col("__lo") < F.col("__hi")) | (F.col("__gap") & F.col("__lo").isNotNull())).select(row_id))
    if mixed.isEmpty():
        return mine
    few = attr.join(mixed, row_id, "left_semi")
    labels = few.select(row_id, F.col(own).alias("cls")).distinct()
    return mine.join(mixed, row_id, "left_anti").unionByName(few.join(labels, [row_id, "cls"], "left_semi"))


def _feature_names(attr: DataFrame) -> list[str]:
    return sorted(r[0] for r in attr.select("feature").where("feature IS NOT NULL").distinct().collect())   # one row per feature


def attribution_points(attr: DataFrame, row_id: str, top: int = 15) -> DataFrame:
    """I-16: class-summed phi per (row, feature) and the feature value scaled to
    [0, 1] over rows, for the top features by mean |phi|.

    A row's cells meet in one aggregated row, which is written: means and bounds of all
    features are one aggregation over it, and the points are made inside it."""
    features = _feature_names(attr)
    if not features:
        return attr.select(row_id, "feature", F.col("phi").alias("phi_sum"), F.col("x").alias("x_scaled")).limit(0)
    of = lambda f, c: F.when(F.col("feature") == f, F.col(c))
    rows = checkpoint(attr.groupBy(row_id).agg(*[e for i, f in enumerate(features) for e in (
        F.sum(of(f, "phi")).alias(f"__s{i}"), F.first(of(f, "x"), ignorenulls=True).alias(f"__x{i}"),
        F.count(F.when(F.col("feature") == f, 1)).alias(f"__n{i}"))]))
    st = rows.agg(*[e for i in range(len(features)) for e in (F.avg(F.abs(f"__s{i}")), F.min(f"__x{i}"), F.max(f"__x{i}"))]).first()
    own = [(f, i, *st[3 * i:3 * i + 3]) for i, f in enumerate(features)]   # one row of bounded width
    # as Spark orders descending: NaN, numbers, NULL
    best = sorted(own, key=lambda o: (2, 0.0, o[0]) if o[2] is None else (0, 0.0, o[0]) if math.isnan(o[2]) else (1, -o[2], o[0]))[:top]
    points = [F.when(F.col(f"__n{i}") > 0, F.struct(
        F.lit(f).alias("feature"), F.col(f"__s{i}").alias("phi_sum"),
        ((F.col(f"__x{i}") - F.lit(lo).cast("double")) / (F.lit(hi).cast("double") - F.lit(lo).cast("double") + 1e-12)).alias("x_scaled"))) for f, i, _, lo, hi in best]
    return rows.select(row_id, F.explode(F.array(*points)).alias("__c")).where("__c IS NOT NULL").select(row_id, "__c.*")


def class_contrast(attr: DataFrame, low_class, high_class) -> DataFrame:
    """I-17: mean phi at the lowest vs the highest class, with +/- counts."""
    c = F.col("cls")
    return attr.where(c.isin(low_class, high_class)).groupBy("feature").agg(
        F.avg(F.when(c == low_class, F.col("phi"))).alias("mean_phi_low"),
        F.avg(F.when(c == high_class, F.col("phi"))).alias("mean_phi_high"),
        F.sum(F.when((c == low_class) & (F.col("phi") > 0), 1).otherwise(0)).alias("n_pos_low"),
        F.sum(F.when((c == low_class) & (F.col("phi") < 0), 1).otherwise(0)).alias("n_neg_low"),
        F.sum(F.when((c == high_class) & (F.col("phi") > 0), 1).otherwise(0)).alias("n_pos_high"),
        F.sum(F.when((c == high_class) & (F.col("phi") < 0), 1).otherwise(0)).alias("n_neg_high"))
