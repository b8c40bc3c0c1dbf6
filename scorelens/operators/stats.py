"""Correlation, rank statistics and hypothesis tests.

Counts, ranks and moments are computed by Spark on long-form data; p-values
come from closed forms evaluated as SQL expressions (normal, chi-square) or,
for Student t and exact small-sample Wilcoxon, from a pandas UDF applied to
the already aggregated rows (one row per test).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.functions import pvalues as PV
from scorelens.plans.helpers import checkpoint, to_long
from scorelens.plans.rank import collapse, distributed_rank, ranked_with_classes


def _pearson(x, y):
    """Pairwise-complete Pearson r, NULL for a constant column (N14)."""
    both = x.isNotNull() & y.isNotNull()
    xb, yb = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(xb, yb), F.stddev_samp(xb) * F.stddev_samp(yb))


# ------------------------------------------------------------------ T-01 … T-03
def corr_with_target(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """T-01: Pearson r of every feature with the target, sorted by |r| desc.

    Long form + one groupBy(feature): partial aggregation keeps the shuffle at
    features x partitions rows whatever the row count.
    """
    long = to_long(df, features, [target])
    return (long.groupBy("feature")
                .agg(_pearson(F.col("value"), F.col(target).cast("double")).alias("r"),
                     F.count(F.col("value")).alias("n"))
                .select("feature", "r", F.abs("r").alias("abs_r"), "n")
                .orderBy(F.col("abs_r").desc_nulls_last(), "feature"))


def pearson_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """All pairs (var1, var2, r) including the diagonal, pairwise-complete.

    A task sums the masked products of its rows' columns (four matrix products a batch:
    rows of both, x, x^2, xy) and hands on p(p-1)/2 rows; one aggregation adds them up.
    Values are taken from each column's mean, so that the sums do not cancel; NaN counts
    as missing. A column without spread among the rows of a pair (relative 1e-12) has no r.
    """
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, r double")
    row = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}")
                      for i, c in enumerate(cols)])
    means = row.agg(*[F.coalesce(F.avg(x), F.lit(0.0)) for x in row.columns]).first()      # one row
    shift = np.asarray(list(means), dtype=float)

    def partial(batches):
        sums = None
        for b in batches:
            x = b.to_numpy(dtype=float, na_value=np.nan) - shift
            has = (~np.isnan(x)).astype(float)
            x = np.where(has > 0, x, 0.0)
            s = np.stack([has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x])
            sums = s if sums is None else sums + s
        if sums is not None:
            i, j = np.triu_indices(len(shift), 1)
            n, x, xx, xy = sums
            yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "sx": x[i, j], "sy": x[j, i], "sxx": xx[i, j],
                                "syy": xx[j, i], "sxy": xy[i, j]})

    g = row.mapInPandas(partial, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    g = g.groupBy(F.struct("i", "j").alias("p")).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    spread = (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy"))
    r = g.select("p", F.when(spread, cov / F.sqrt(vx * vy)).alias("r"))
    name = F.array(*[F.lit(c) for c in cols])
    v1, v2 = name[F.col("p.i")], name[F.col("p.j")]
    both = F.array(F.struct(v1.alias("var1"), v2.alias("var2"), "r"), F.struct(v2.alias("var1"), v1.alias("var2"), "r"))
    same = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "var1 string, var2 string, r double")
    return r.select(F.inline(both)).unionByName(same)


def corr_matrix_topn(df: DataFrame, features: list[str], target: str, n: int) -> DataFrame:
    """T-02: r matrix over the n features with the largest |r| to the target.

    The choice of n names is a driver decision on a per-feature table
    (bounded by the number of features)."""
    top = [r["feature"] for r in corr_with_target(df, features, target).limit(n).collect()]
    return pearson_matrix(df, top)


def collinear_pairs(df: DataFrame, features: list[str], threshold: float = 0.9) -> DataFrame:
    """T-03: pairs i < j (column order) with |r| >= threshold, sorted by |r| desc."""
    order = {c: i for i, c in enumerate(features)}
    m = pearson_matrix(df, features)
    idx = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    return (m.where(idx[F.col("var1")] < idx[F.col("var2")])
             .where(F.abs("r") >= threshold)
             .select("var1", "var2", F.col("r").alias("correlation"))
             .orderBy(F.abs("correlation").desc(), "var1", "var2"))


# ---------------------------------------------------------------- ranks, T-04/5
def average_rank(df: DataFrame, value: str, groups: list[str] | None = None,
                 ascending: bool = True, out: str = "rank") -> DataFrame:
    """T-05: per-row average rank (ties share the mean position)."""
    from scorelens.plans.rank import average_rank_rows
    return average_rank_rows(df, value, groups, ascending, out)


def feature_ranks(df: DataFrame, features: list[str], cls: str) -> DataFrame:
    """Every feature's values ranked with the class counts beside them: the table that
    ``spearman_with_target``, ``kruskal_wallis`` and ``mutual_information`` share (their
    ``ranked``), so that rows are ranked once for all three."""
    return checkpoint(ranked_with_classes(to_long(df, features, [cls]), ["feature"], "value", cls))


def spearman_with_target(df: DataFrame, features: list[str], target: str, ranked: DataFrame | None = None) -> DataFrame:
    """T-04: Spearman rho of every feature with the target, the t statistic and its
    two-sided p-value (n - 2 degrees of freedom; NULL where rho or t is).

    Feature values are ranked with the targets' counts beside them; summed by target they
    carry what rho needs of the feature's ranks, and the targets are ranked last. No join:
    rho = Pearson of the average ranks.
    """
    if ranked is None:
        ranked = ranked_with_classes(to_long(df, features, [target]), ["feature"], "value", target)
    rx, c = F.col("avg_rank"), F.col("__n").cast("double")
    by_target = (ranked.select("feature", "avg_rank", F.inline("by_class"))
                 .groupBy("feature", target).agg(F.sum("__n").alias("w"), F.sum(c * rx).alias("x"), F.sum(c * rx * rx).alias("xx")))
    ry, w = F.col("avg_rank"), F.col("w").cast("double")
    m = distributed_rank(by_target, ["feature"], target).groupBy("feature").agg(
        F.sum(w).alias("n"), F.sum("x").alias("sx"), F.sum(w * ry).alias("sy"), F.sum("xx").alias("sxx"),
        F.sum(w * ry * ry).alias("syy"), F.sum(F.col("x") * ry).alias("sxy"))
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    rho = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    res = m.select("feature", rho.alias("rho"), n.cast("long").alias("n"))
    t = F.col("rho") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1.0 - F.col("rho") * F.col("rho")))
    res = res.select("feature", "rho", "n", t.alias("t_stat"), (F.col("n") - 2).alias("__df"))
    return with_t_pvalue(res, "t_stat", "__df").drop("__df")


def with_t_pvalue(df: DataFrame, t_col: str, df_col: str, out: str = "p_value") -> DataFrame:
    """Two-sided Student-t p-value, pandas UDF over already aggregated rows."""
    @F.pandas_udf(T.DoubleType())
    def _p(t: pd.Series, d: pd.Series) -> pd.Series:
        p = PV.t_two_sided(t.astype(float).to_numpy(), d.astype(float).to_numpy()) if len(t) else []
        return pd.Series([None if np.isnan(x) else x for x in p], dtype="float64")
    return df.withColumn(out, _p(F.col(t_col).cast("double"), F.col(df_col).cast("double")))


# ------------------------------------------------------------------ T-06 / T-07
def kruskal_wallis(df: DataFrame, features: list[str], class_col: str, min_group: int = 3,
                   alpha: float = 0.05, ranked: DataFrame | None = None) -> DataFrame:
    """T-06: Kruskal-Wallis H (tie-corrected), p, eta^2 per feature.

    Groups (classes) with fewer than ``min_group`` non-null values of a feature
    are dropped for that feature; k counts the kept groups (B9).
    """
    long = (to_long(df.where(F.col(class_col).isNotNull()), features, [class_col])
            .where(F.col("value").isNotNull()))
    counts = (long.groupBy("feature", class_col).agg(F.count(F.lit(1)).alias("nj")) if ranked is None else
              ranked.select("feature", F.inline("by_class")).groupBy("feature", class_col).agg(F.sum("__n").alias("nj")))
    small = counts.where(F.col("nj") < min_group).select("feature", class_col)
    if not small.isEmpty():
        long, ranked = long.join(small, ["feature", class_col], "left_anti"), None
    if ranked is None:
        ranked = ranked_with_classes(long, ["feature"], "value", class_col)
    # one aggregation by (feature, class); the ties of a value are counted once, with its first class
    each = ranked.select("feature", "avg_rank", "group_n", "w", F.posexplode("by_class").alias("i", "b"))
    w = F.col("w").cast("double")
    rj = (each.groupBy("feature", F.col(f"b.{class_col}").alias(class_col))
              .agg(F.sum(F.col("b.__n") * F.col("avg_rank")).alias("R"), F.sum("b.__n").alias("nj"),
                   F.sum(F.when(F.col("i") == 0, w * w * w - w).otherwise(F.lit(0.0))).alias("tie"),
                   F.first("group_n").alias("group_n")))
    j = rj.groupBy("feature").agg(F.sum(F.col("R") * F.col("R") / F.col("nj")).alias("s"), F.count(F.lit(1)).alias("k"),
                                  F.sum("tie").alias("tie_sum"), F.first("group_n").alias("N"))
    N = F.col("N").cast("double")
    h_raw = 12.0 / (N * (N + 1)) * F.col("s") - 3 * (N + 1)
    corr = 1 - F.try_divide(F.col("tie_sum"), N * N * N - N)
    h = F.when(F.col("k") >= 2, F.try_divide(h_raw, corr))
    out = j.select("feature", F.col("k").cast("long").alias("k"), F.col("N").cast("long").alias("n"),
                   h.alias("h"))
    out = out.withColumn("p_value", PV.chi2_sf_column(F.col("h"), F.col("k") - 1))
    eta = F.greatest(F.try_divide(F.col("h") - F.col("k") + 1, (F.col("n") - F.col("k")).cast("double")), F.lit(0.0))
    return out.select("feature", "k", "n", "h", "p_value",
                      F.when(F.col("h").isNotNull(), eta).alias("eta2"),
                      (F.col("p_value") < alpha).alias("significant"))


def kw_screen(kw: DataFrame, top: int = 5, alpha: float = 0.05, weak_eta: float = 0.01) -> DataFrame:
    """T-07: count and % significant, top features by eta^2, weak list."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("eta2").desc_nulls_last(), "feature")
    r = kw.withColumn("_r", F.row_number().over(w))
    return r.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.sum(F.when(F.col("p_value") < alpha, 1).otherwise(0)).alias("n_significant"),
        (F.avg(F.when(F.col("p_value") < alpha, 1.0).otherwise(0.0)) * 100).alias("pct_significant"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", "feature")))),
                                 lambda s: s["feature"]), ",").alias("top_features"),
        F.array_join(F.sort_array(F.collect_list(F.when((F.col("eta2") < weak_eta) & (F.col("p_value") >= alpha),
                                                        F.col("feature")))), ",").alias("weak_features"))


# --------------------------------------------------------------- T-08 / T-09
def mann_whitney_u(df: DataFrame, value: str, group: str, positive, by: list[str] | None = None,
                   alternative: str = "greater") -> DataFrame:
    """T-08: U of the ``positive`` group vs the rest, normal approximation with
    tie and continuity correction (scipy ``asymptotic``), per ``by`` group."""
    by = by or []
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(
        *by, F.col(value).cast("double").alias("v"), (F.col(group) == F.lit(positive)).alias("g1"))
    c = d.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("w"),
                                F.sum(F.when(F.col("g1"), 1).otherwise(0)).alias("w1"))
    r = distributed_rank(c, by, "v")
    s = r.groupBy(*by).agg(F.sum(F.col("w1") * F.col("avg_rank")).alias("R1"),
                           F.sum("w1").alias("n1"), (F.sum("w") - F.sum("w1")).alias("n2"),
                           F.sum(F.col("w").cast("double") ** 3 - F.col("w")).alias("tie_sum"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("R1") - n1 * (n1 + 1) / 2
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie_sum") / (n * (n - 1))))
    out = s.select(*by, F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
                   u.alias("u"), mu.alias("mu"), sigma.alias("sigma"))
    if alternative == "greater":
        z = F.expr("(u - mu - 0.5e0) / nullif(sigma, 0)")
        p = PV.norm_sf_column(z)
    elif alternative == "less":
        z = F.expr("(u - mu + 0.5e0) / nullif(sigma, 0)")
        p = 1.0 - PV.norm_sf_column(z)
    else:
        z = F.expr("(abs(u - mu) - 0.5e0) / nullif(sigma, 0)")
        p = F.least(F.lit(1.0), 2.0 * PV.norm_sf_column(z))
    return out.select(*by, "n1", "n2", "u", z.alias("z"), p.alias("p_value"))


def welch_t(df: DataFrame, value: str, group: str, positive, by: list[str] | None = None,
            with_p: bool = True) -> DataFrame:
    """T-09: Welch t (positive group minus rest) and Welch-Satterthwaite df."""
    by = by or []
    g = F.col(group) == F.lit(positive)
    v = F.col(value).cast("double")
    s = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by).agg(
        F.avg(F.when(g, v)).alias("m1"), F.avg(F.when(~g, v)).alias("m2"),
        F.var_samp(F.when(g, v)).alias("v1"), F.var_samp(F.when(~g, v)).alias("v2"),
        F.count(F.when(g, v)).alias("n1"), F.count(F.when(~g, v)).alias("n2"))
    a = F.col("v1") / F.col("n1")
    b = F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(a + b))
    dof = F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    out = s.select(*by, "n1", "n2", "m1", "m2", t.alias("t_stat"), dof.alias("dof"))
    return with_t_pvalue(out, "t_stat", "dof") if with_p else out


# ---------------------------------------------------------- T-10 / T-11 / T-15
def _block_ranks(scores: DataFrame, keys: list[str], block: str, treatment: str, value: str,
                 descending: bool = False) -> DataFrame:
    """Average rank of each treatment inside a block. A block holds one row per
    treatment (models / raters), so the window is bounded by the treatment count."""
    o = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy(*keys, block).orderBy(o)
    wt = Window.partitionBy(*keys, block, value)
    return scores.select(*keys, block, treatment, value,
                         (F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0).alias("rk"),
                         F.count(F.lit(1)).over(wt).alias("tie"))


def friedman_test(scores: DataFrame, block: str, treatment: str, value: str,
                  by: list[str] | None = None) -> DataFrame:
    """T-10: Friedman chi^2 (tie-corrected) and p over k treatments x n blocks.

    NULL statistic with a note when k < 3 or n < 3. Blocks with a missing
    treatment are dropped (complete blocks only, as scipy requires).
    """
    if not by:
        res = friedman_test(scores.withColumn("__all", F.lit(1)), block, treatment, value, ["__all"])
        return res.drop("__all")
    s = scores.where(F.col(value).isNotNull())
    k_all = s.groupBy(*by).agg(F.count_distinct(treatment).alias("k"))
    bsz = s.groupBy(*by, block).agg(F.count(F.lit(1)).alias("bk"))
    full = bsz.join(k_all, by).where(F.col("bk") == F.col("k")).select(*by, block)
    s = s.join(full, [*by, block], "left_semi")
    r = _block_ranks(s, by, block, treatment, value)
    rj = r.groupBy(*by, treatment).agg(F.sum("rk").alias("R"))
    tie = (r.groupBy(*by, block, value).agg(F.first("tie").alias("t"))
            .groupBy(*by).agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("tie_sum"),
                              F.count_distinct(block).alias("n")))
    agg_ = rj.groupBy(*by).agg(F.sum(F.col("R") * F.col("R")).alias("sr2"), F.count(F.lit(1)).alias("k"))
    j = agg_.join(tie, by)
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    chi = 12.0 / (n * k * (k + 1)) * F.col("sr2") - 3 * n * (k + 1)
    c = 1 - F.col("tie_sum") / (n * k * (k * k - 1))
    ok = (F.col("k") >= 3) & (F.col("n") >= 3)
    out = j.select(*by, F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"),
                   F.when(ok, F.try_divide(chi, c)).alias("chi2"),
                   F.when(~ok, F.lit("need k >= 3 and n >= 3")).alias("note"))
    return out.withColumn("p_value", PV.chi2_sf_column(F.col("chi2"), F.col("k") - 1))


def friedman_per_feature(imp: DataFrame, feature: str, model: str, repeat: str, value: str,
                         alpha: float = 0.05) -> DataFrame:
    """T-11: Friedman across models for every feature, repeats as blocks,
    Bonferroni over the number of features (p x m capped at 1)."""
    f = friedman_test(imp, repeat, model, value, by=[feature])
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return (f.withColumn("p_adj", F.least(F.col("p_value") * m, F.lit(1.0)))
             .withColumn("significant", F.col("p_adj") < alpha))


def kendall_w(ratings: DataFrame, rater: str, obj: str, value: str, descending: bool = False) -> DataFrame:
    """T-15: Kendall's W = 12 S / (k^2 (n^3 - n) + 1e-15), chi^2 = k (n - 1) W, p."""
    r = _block_ranks(ratings.where(F.col(value).isNotNull()), [], rater, obj, value, descending)
    ri = r.groupBy(obj).agg(F.sum("rk").alias("R"))
    s = ri.agg(F.count(F.lit(1)).alias("n"), F.sum("R").alias("sR"), F.sum(F.col("R") * F.col("R")).alias("sR2"))
    k = r.agg(F.count_distinct(rater).alias("k"))
    j = s.crossJoin(k)
    n, kk = F.col("n").cast("double"), F.col("k").cast("double")
    S = F.col("sR2") - F.col("sR") * F.col("sR") / n
    W = 12 * S / (kk * kk * (n * n * n - n) + 1e-15)
    out = j.select(F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"), W.alias("w"))
    out = out.withColumn("chi2", F.col("k") * (F.col("n") - 1) * F.col("w"))
    return out.withColumn("p_value", PV.chi2_sf_column(F.col("chi2"), F.col("n") - 1))


# -------------------------------------------------------------- Wilcoxon family
def _signed_rank(d: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """W+, W-, n (non-zero), tie info per key from the differences column.

    The number of pairs per key is the number of blocks (seeds / repeats), so
    a window per key is bounded."""
    nz = d.where(F.col(diff).isNotNull() & (F.col(diff) != 0))
    a = F.abs(F.col(diff))
    w = Window.partitionBy(*keys).orderBy(a)
    wt = Window.partitionBy(*keys, a)
    r = nz.select(*keys, diff, (F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0).alias("rk"),
                  F.count(F.lit(1)).over(wt).alias("t"))
    s = r.groupBy(*keys).agg(
        F.sum(F.when(F.col(diff) > 0, F.col("rk")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col(diff) < 0, F.col("rk")).otherwise(0.0)).alias("w_minus"),
        F.count(F.lit(1)).alias("n"),
        F.max("t").alias("max_tie"),
        F.sum(F.col("t").cast("double") ** 2 - 1).alias("tie_term"))   # sum over rows of (t^2-1) = sum over groups (t^3-t)
    allk = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"))
    return allk.join(s, keys, "left").select(
        *keys, "n_pairs", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("w_minus", F.lit(0.0)).alias("w_minus"),
        F.coalesce("max_tie", F.lit(1)).alias("max_tie"), F.coalesce("tie_term", F.lit(0.0)).alias("tie_term"))


def _wilcoxon_exact_udf(alternative: str):
    @F.pandas_udf(T.DoubleType())
    def _p(w_plus: pd.Series, n: pd.Series, exact: pd.Series) -> pd.Series:
        return pd.Series([PV.wilcoxon_exact_p(wp, int(nn), alternative) if use and nn > 0 else float("nan")
                          for wp, nn, use in zip(w_plus, n, exact)], dtype=float)
    return _p


def _wilcoxon_z_sql(q: str = "") -> str:
    n, tt, wp = f"{q}n", f"{q}tie_term", f"{q}w_plus"
    mu = f"({n} * ({n} + 1) / 4e0)"
    se = f"sqrt({n} * ({n} + 1) * (2 * {n} + 1) / 24e0 - {tt} / 48e0)"
    return f"(({wp} - {mu}) / nullif({se}, 0))"


def wilcoxon_normal_p_sql(alternative: str, q: str = "") -> str:
    """Normal approximation with tie correction, no continuity correction, as text for
    the oracle. ``q`` qualifies the column names (``n``, ``tie_term``, ``w_plus``)."""
    z = _wilcoxon_z_sql(q)
    if alternative == "two-sided":
        p = f"least(1e0, 2e0 * {PV.norm_sf_sql(f'abs({z})')})"
    elif alternative == "greater":
        p = PV.norm_sf_sql(z)
    else:
        p = f"(1e0 - {PV.norm_sf_sql(z)})"
    return f"coalesce({p}, 1e0)"


WILCOXON_METHODS = ("auto", "exact", "approx")


def _wilcoxon_p(alternative: str, method: str = "auto", exact_max_n: int = 50):
    """p-value by ``method``: 'exact' takes the exact distribution wherever there are
    no zeros or ties (it does not exist otherwise), 'approx' the normal approximation
    everywhere, 'auto' the exact one up to ``exact_max_n`` differences (the usual
    library rule, default 50); n = 0 -> 1."""
    if method not in WILCOXON_METHODS:
        raise ValueError(f"method must be one of {WILCOXON_METHODS}")
    exact_ok = (F.col("n") > 0) & (F.col("n") == F.col("n_pairs")) & (F.col("max_tie") <= 1)
    if method == "auto":
        exact_ok = exact_ok & (F.col("n") <= exact_max_n)
    elif method == "approx":
        exact_ok = F.lit(False)
    z = F.expr(_wilcoxon_z_sql())
    approx = {"two-sided": F.least(F.lit(1.0), 2.0 * PV.norm_sf_column(F.abs(z))), "greater": PV.norm_sf_column(z),
              "less": 1.0 - PV.norm_sf_column(z)}[alternative]
    return (F.when(F.col("n") == 0, F.lit(1.0))
             .when(exact_ok, _wilcoxon_exact_udf(alternative)(F.col("w_plus"), F.col("n"), exact_ok))
             .otherwise(F.coalesce(approx, F.lit(1.0))))


def wilcoxon_pairs(scores: DataFrame, block: str, treatment: str, value: str,
                   by: list[str] | None = None, alpha: float = 0.05, method: str = "auto") -> DataFrame:
    """T-12: signed-rank test for every treatment pair a < b over shared blocks;
    all-zero differences -> (W 0, p 1); Bonferroni over the pairs of a group."""
    by = by or []
    a = scores.select(*by, block, F.col(treatment).alias("a"), F.col(value).alias("va"))
    b = scores.select(*by, block, F.col(treatment).alias("b"), F.col(value).alias("vb"))
    d = (a.join(b, [*by, block]).where(F.col("a") < F.col("b"))
          .select(*by, "a", "b", block, (F.col("va") - F.col("vb")).alias("d")))
    s = _signed_rank(d, [*by, "a", "b"], "d")
    s = s.withColumn("w", F.least("w_plus", "w_minus"))
    s = s.withColumn("p_value", _wilcoxon_p("two-sided", method))
    m = F.count(F.lit(1)).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    return (s.withColumn("p_adj", F.least(F.col("p_value") * m, F.lit(1.0)))
             .withColumn("significant", F.col("p_adj") < alpha))


def wilcoxon_vs_baseline(scores: DataFrame, block: str, treatment: str, value: str, baseline: str,
                         by: list[str] | None = None, alpha: float = 0.05, min_n: int = 3,
                         method: str = "auto") -> DataFrame:
    """T-13: every treatment vs one baseline; Bonferroni factor = tests run
    (treatments x ``by`` groups); skipped (NULL) when n < min_n or all zero."""
    by = by or []
    base = scores.where(F.col(treatment) == baseline).select(*by, block, F.col(value).alias("vb"))
    oth = scores.where(F.col(treatment) != baseline).select(*by, block, treatment, F.col(value).alias("va"))
    d = oth.join(base, [*by, block]).select(*by, treatment, block, (F.col("va") - F.col("vb")).alias("d"))
    s = _signed_rank(d, [*by, treatment], "d")
    ok = (F.col("n_pairs") >= min_n) & (F.col("n") > 0)
    s = s.withColumn("w", F.when(ok, F.least("w_plus", "w_minus")))
    s = s.withColumn("p_value", F.when(ok, _wilcoxon_p("two-sided", method)))
    m = F.count(F.col("p_value")).over(Window.partitionBy(F.lit(1)))
    return (s.withColumn("p_adj", F.least(F.col("p_value") * m, F.lit(1.0)))
             .withColumn("significant", F.col("p_adj") < alpha))


def wilcoxon_gt_zero(df: DataFrame, key: str, value: str, alpha: float = 0.05, method: str = "auto") -> DataFrame:
    """T-14: one-sample one-sided signed-rank test of value > 0 per key.

    All zero -> p 1; all values positive and equal -> p 0 (forced, as the
    reference does); flag p < alpha / N with N keys; ``min_attainable_p``
    = 1 / 2^n documents the floor of the exact test (B3)."""
    s = _signed_rank(df.select(key, F.col(value).alias("d")), [key], "d")
    stats_ = df.groupBy(key).agg(F.min(value).alias("mn"), F.max(value).alias("mx"))
    s = s.join(stats_, key)
    p_raw = _wilcoxon_p("greater", method)
    p = (F.when(F.col("n") == 0, 1.0)
         .when((F.col("mn") == F.col("mx")) & (F.col("mn") > 0), 0.0)
         .otherwise(p_raw))
    n_keys = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    out = s.select(key, "n", "w_plus", p.alias("p_value"),
                   F.pow(F.lit(0.5), F.col("n")).alias("min_attainable_p"), n_keys.alias("n_tests"))
    out = out.withColumn("significant", F.col("p_value") < alpha / F.col("n_tests"))
    return out.withColumn("n_sig", F.sum(F.col("significant").cast("int")).over(Window.partitionBy(F.lit(1))))


# ------------------------------------------------------------ T-16 … T-19
def bonferroni_adjust(df: DataFrame, p_col: str, m: int | None = None, alpha: float = 0.05,
                      out: str = "p_adj") -> DataFrame:
    """T-16: min(1, p * m); m defaults to the number of tests (rows)."""
    mm = F.lit(m) if m is not None else F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return (df.withColumn(out, F.least(F.col(p_col) * mm, F.lit(1.0)))
              .withColumn(f"{out}_sig", F.col(out) < alpha))


def linear_trend(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """T-17: least-squares slope and intercept of y on x (NULL on constant x)."""
    by = by or []
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"),
                 F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
                 F.regr_count(F.col(y).cast("double"), F.col(x).cast("double")).alias("n"))


def ci95_mean(df: DataFrame, value: str, by: list[str] | None = None, z: float = 1.96) -> DataFrame:
    """T-18: mean +/- z * s / sqrt(n)."""
    by = by or []
    g = df.groupBy(*by) if by else df.groupBy()
    v = F.col(value).cast("double")
    s = g.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))
    half = z * F.col("std") / F.sqrt(F.col("n").cast("double"))
    return s.select("*", half.alias("half_width"), (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def rank_bins(df: DataFrame, features: list[str], bins: int = 10, ids: list[str] | None = None) -> DataFrame:
    """Equal-frequency bin of each value from its exact rank: ``floor(before * bins / N)``.
    Equal values share ``before`` and so never straddle two bins."""
    ids = ids or []
    long = to_long(df, features, ids).where(F.col("value").isNotNull())
    r = distributed_rank(collapse(long, ["feature"], "value"), ["feature"], "value").select(
        "feature", "value", F.least(F.floor(F.col("before") * bins / F.col("group_n")), F.lit(bins - 1))
        .cast("int").alias("bin"))
    return long.join(r, ["feature", "value"])


def mutual_information(df: DataFrame, features: list[str], class_col: str, bins: int = 10,
                       ranked: DataFrame | None = None) -> DataFrame:
    """T-19: binned mutual information (nats) of each feature with the class.

    Deterministic plug-in estimate on exact equal-frequency bins; it ranks
    features like the k-NN estimator but its values differ."""
    bin_ = F.least(F.floor(F.col("before") * bins / F.col("group_n")), F.lit(bins - 1)).cast("int")
    if ranked is None:
        ranked = ranked_with_classes(to_long(df, features, [class_col]), ["feature"], "value", class_col)
    joint = (ranked.select("feature", bin_.alias("bin"), F.inline("by_class"))
             .groupBy("feature", "bin", class_col).agg(F.sum("__n").alias("nbc")))
    wf = Window.partitionBy("feature")
    j = joint.select("*", F.sum("nbc").over(wf).alias("N"),
                     F.sum("nbc").over(Window.partitionBy("feature", "bin")).alias("nb"),
                     F.sum("nbc").over(Window.partitionBy("feature", class_col)).alias("nc"))
    term = (F.col("nbc") / F.col("N")) * F.log(F.col("nbc") * F.col("N") / (F.col("nb") * F.col("nc")))
    return (j.groupBy("feature").agg(F.sum(term).alias("mi"))
             .orderBy(F.col("mi").desc(), "feature"))
