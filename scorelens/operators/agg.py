"""Aggregation, grouping, pivots, top-k.

Plan notes: every operator is one ``groupBy`` (partial aggregation on the map
side, one shuffle keyed by the segment) or works on an already aggregated,
bounded result (classes, segments, features, models).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.plans.helpers import grand_mean


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """A-01: count and percentage per class (NULL class dropped, N11)."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    # window over the per-class aggregate: bounded by the number of classes
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select(target, "n", (F.col("n") * 100.0 / total).alias("pct")).orderBy(target)


def segment_kpi(df: DataFrame, segments: list[str], target: str, value_cols: list[str]) -> DataFrame:
    """A-02: per segment level: n, mean target, grand mean of a column group.

    All segment columns in one scan (grouping sets); the reference scans once
    per segment and metric.
    """
    agg_exprs = [F.count(F.lit(1)).alias("n"),
                 F.avg(F.col(target).cast("double")).alias("mean_target"),
                 grand_mean(value_cols).alias("mean_group")]
    if len(segments) == 1:
        s = segments[0]
        out = df.groupBy(s).agg(*agg_exprs).select(
            F.lit(s).alias("segment"), F.col(s).cast("string").alias("level"), "n", "mean_target", "mean_group")
    else:
        sets = [[F.col(s)] for s in segments]
        g = df.groupingSets(sets, *segments).agg(*agg_exprs, *[F.grouping(s).alias(f"_g_{s}") for s in segments])
        seg_name = None
        level = None
        for s in segments:
            cond = F.col(f"_g_{s}") == 0
            seg_name = F.when(cond, F.lit(s)) if seg_name is None else seg_name.when(cond, F.lit(s))
            level = F.when(cond, F.col(s).cast("string")) if level is None else level.when(cond, F.col(s).cast("string"))
        out = g.select(seg_name.alias("segment"), level.alias("level"), "n", "mean_target", "mean_group")
    return out.orderBy(F.col("segment"), F.col("mean_target").desc(), F.col("level"))


def trend_by_year(df: DataFrame, year_col: str, target: str, value_cols: list[str]) -> DataFrame:
    """A-03: the segment KPI per year, ordered by year."""
    return (df.groupBy(year_col)
              .agg(F.count(F.lit(1)).alias("n"),
                   F.avg(F.col(target).cast("double")).alias("mean_target"),
                   grand_mean(value_cols).alias("mean_group"))
              .orderBy(year_col))


def class_profile(df: DataFrame, target: str, value_cols: list[str]) -> DataFrame:
    """A-04: mean of each score column per target class."""
    return (df.groupBy(target)
              .agg(F.count(F.lit(1)).alias("n"),
                   *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in value_cols])
              .orderBy(target))


def domain_part_means(df: DataFrame, cols: list[str], sep: str = "_") -> DataFrame:
    """A-05: structured names ``{domain}{sep}{part}`` -> mean per (domain, part).

    Per-column partial sums first (one row), unpivot after: no row blow-up.
    """
    sums = df.agg(*[F.sum(F.col(c).cast("double")).alias(f"s__{c}") for c in cols],
                  *[F.count(F.col(c)).alias(f"n__{c}") for c in cols])
    stack = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"s__{c}").alias("s"), F.col(f"n__{c}").alias("n"))
        for c in cols]))
    long = sums.select(stack)
    dom = F.split(F.col("column"), sep, 2)
    return (long.select(dom[0].alias("domain"),
                        F.coalesce(dom[1], F.lit("")).alias("part"),
                        "column", F.try_divide(F.col("s"), F.col("n").cast("double")).alias("mean"),
                        F.col("n").alias("n"))
                .orderBy("domain", "part"))


def grade_share_by_segment(df: DataFrame, segment: str, target: str, worst: int = 1,
                           high: tuple[int, ...] = (4, 5), top: int = 5) -> DataFrame:
    """A-06: % of rows with grade = worst, in ``high``, = top, per segment."""
    t = F.col(target)
    return (df.groupBy(segment)
              .agg(F.count(F.lit(1)).alias("n"),
                   (F.avg(F.when(t == worst, 1.0).otherwise(0.0)) * 100).alias("pct_worst"),
                   (F.avg(F.when(t.isin(*high), 1.0).otherwise(0.0)) * 100).alias("pct_high"),
                   (F.avg(F.when(t == top, 1.0).otherwise(0.0)) * 100).alias("pct_top"))
              .orderBy(segment))


def segment_summary(df: DataFrame, segment: str, target: str, high: tuple[int, ...] = (4, 5),
                    low: tuple[int, ...] = (1, 2)) -> DataFrame:
    """A-07: n, mean, sample std, high %, low % and the grade distribution text.

    Collapses to (segment, grade) counts first; the second aggregation runs on
    at most segments x grades rows.
    """
    t = F.col(target)
    pc = (df.where(t.isNotNull()).groupBy(segment, target)
            .agg(F.count(F.lit(1)).alias("c")))
    g = F.col(target).cast("double")
    n = F.sum("c")
    s1 = F.sum(g * F.col("c"))
    s2 = F.sum(g * g * F.col("c"))
    dist = F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(target).alias("k"), F.col("c").alias("v")))),
        lambda x: F.concat(x["k"].cast("string"), F.lit(":"), x["v"].cast("string"))), ", ")
    return (pc.groupBy(segment)
              .agg(n.alias("n"),
                   (s1 / n).alias("mean"),
                   F.sqrt(F.try_divide(s2 - s1 * s1 / n, (n - 1).cast("double"))).alias("std"),
                   (F.sum(F.when(t.isin(*high), F.col("c")).otherwise(0)) * 100.0 / n).alias("pct_high"),
                   (F.sum(F.when(t.isin(*low), F.col("c")).otherwise(0)) * 100.0 / n).alias("pct_low"),
                   dist.alias("distribution"))
              .orderBy(segment))


def crosstab_pct(df: DataFrame, segment: str, target: str, levels: list) -> DataFrame:
    """A-08: segment x grade, row-normalised percentages, explicit level list
    (no extra job to discover pivot values)."""
    t = F.col(target)
    return (df.where(t.isNotNull()).groupBy(segment)
              .agg(*[(F.sum(F.when(t == v, 1).otherwise(0)) * 100.0 / F.count(F.lit(1))).alias(f"pct_{v}")
                     for v in levels])
              .orderBy(segment))


def segment_feature_means(df: DataFrame, segment: str, value_cols: list[str]) -> DataFrame:
    """A-09: segment x chosen columns, mean."""
    return (df.groupBy(segment)
              .agg(F.count(F.lit(1)).alias("n"),
                   *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in value_cols])
              .orderBy(segment))


def global_kpi(df: DataFrame, target: str, segments: list[str], value_cols: list[str],
               worst: int = 1, top: int = 5) -> DataFrame:
    """A-10: one row of headline KPIs, including the strongest correlate of the target."""
    t = F.col(target).cast("double")
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.avg(t).alias("mean_target"),
            grand_mean(value_cols).alias("mean_group"),
            (F.avg(F.when(F.col(target) == worst, 1.0).otherwise(0.0)) * 100).alias("pct_worst"),
            (F.avg(F.when(F.col(target) == top, 1.0).otherwise(0.0)) * 100).alias("pct_top")]
    aggs += [F.count_distinct(s).alias(f"n_{s}") for s in segments]
    aggs += [F.try_divide(F.covar_samp(F.col(c), t), F.stddev_samp(F.col(c)) * F.stddev_samp(t)).alias(f"r__{c}")
             for c in value_cols]
    row = df.agg(*aggs)
    best = F.array_max(F.array(*[F.struct(F.abs(F.col(f"r__{c}")).alias("a"), F.lit(c).alias("f"))
                                 for c in value_cols]))
    return row.select(F.lit(len(df.columns)).alias("n_cols"), "n_rows", "mean_target", "mean_group",
                      "pct_worst", "pct_top", *[f"n_{s}" for s in segments],
                      best["f"].alias("top_feature"), best["a"].alias("top_abs_r"))


def best_worst_segment(kpi: DataFrame) -> DataFrame:
    """A-11: first and last level of each segment by mean target (ties: level asc)."""
    w_best = Window.partitionBy("segment").orderBy(F.col("mean_target").desc(), F.col("level"))
    w_worst = Window.partitionBy("segment").orderBy(F.col("mean_target").asc(), F.col("level"))
    k = kpi.select("segment", "level", "mean_target",
                   F.row_number().over(w_best).alias("rb"), F.row_number().over(w_worst).alias("rw"))
    return (k.groupBy("segment")
             .agg(F.max(F.when(F.col("rb") == 1, F.col("level"))).alias("best_level"),
                  F.max(F.when(F.col("rb") == 1, F.col("mean_target"))).alias("best_mean"),
                  F.max(F.when(F.col("rw") == 1, F.col("level"))).alias("worst_level"),
                  F.max(F.when(F.col("rw") == 1, F.col("mean_target"))).alias("worst_mean")))


def grade_gap(df: DataFrame, target: str, value_cols: list[str], low: int = 1, high: int = 5) -> DataFrame:
    """A-12: mean of each column at grade ``low`` minus at grade ``high`` (long form)."""
    t = F.col(target)
    row = df.agg(*[F.avg(F.when(t == low, F.col(c).cast("double"))).alias(f"lo__{c}") for c in value_cols],
                 *[F.avg(F.when(t == high, F.col(c).cast("double"))).alias(f"hi__{c}") for c in value_cols])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"lo__{c}").alias("mean_low"),
                 F.col(f"hi__{c}").alias("mean_high"),
                 (F.col(f"lo__{c}") - F.col(f"hi__{c}")).alias("gap")) for c in value_cols])))


def top_k(df: DataFrame, by: str, k: int, ascending: bool = False, tie_break: list[str] | None = None) -> DataFrame:
    """A-13: top k rows (TakeOrderedAndProject: per-partition top k, then merge)."""
    o = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(o, *[F.col(c) for c in (tie_break or [])]).limit(k)


def domain_score_rollup(scores: DataFrame, tagged_domain_col: str = "domain", score_col: str = "score",
                        feature_col: str = "feature", k: int = 20) -> DataFrame:
    """A-14: top-k features by score -> sum of score and share per domain."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.col(score_col).desc(), F.col(feature_col))
    top = scores.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    g = top.groupBy(tagged_domain_col).agg(F.count(F.lit(1)).alias("n_features"),
                                           F.sum(score_col).alias("score_sum"))
    tot = F.sum("score_sum").over(Window.partitionBy(F.lit(1)))
    return g.select(tagged_domain_col, "n_features", "score_sum",
                    (F.col("score_sum") * 100.0 / tot).alias("share_pct")).orderBy(F.col("score_sum").desc())


def dataset_meta(df: DataFrame, split_col: str, target: str, level_col: str) -> DataFrame:
    """A-15: per split: rows, share of all rows, class counts text, sorted distinct levels."""
    pc = df.groupBy(split_col, target).agg(F.count(F.lit(1)).alias("c"))
    lv = df.groupBy(split_col).agg(F.array_join(F.sort_array(F.collect_set(F.col(level_col).cast("string"))), ",")
                                   .alias("levels"))
    per = pc.groupBy(split_col).agg(
        F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_classes"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(target).alias("k"), F.col("c").alias("v")))),
                                 lambda x: F.concat(x["k"].cast("string"), F.lit(":"), x["v"].cast("string"))), ",")
        .alias("class_counts"))
    tot = F.sum("n_rows").over(Window.partitionBy(F.lit(1)))
    return per.join(lv, split_col).select(split_col, "n_rows", (F.col("n_rows") * 1.0 / tot).alias("share"),
                                          "n_classes", "class_counts", "levels")


def pivot_mean_matrix(long: DataFrame, row: str, col_: str, value: str, col_values: list[str]) -> DataFrame:
    """A-16: long -> row x column matrix of means (explicit pivot values)."""
    return long.groupBy(row).pivot(col_, col_values).agg(F.avg(value)).orderBy(row)


def argmax_by(long: DataFrame, group: str, item: str, value: str, higher_is_better: bool = True) -> DataFrame:
    """A-17: per group, the item with the best mean value (ties: item asc)."""
    m = long.groupBy(group, item).agg(F.avg(value).alias("mean_value"))
    o = F.col("mean_value").desc() if higher_is_better else F.col("mean_value").asc()
    w = Window.partitionBy(group).orderBy(o, F.col(item))
    return (m.withColumn("_r", F.row_number().over(w)).where("_r = 1")
             .select(group, F.col(item).alias(f"best_{item}"), "mean_value"))


def cumulative_share(scores: DataFrame, feature_col: str = "feature", score_col: str = "score",
                     k: int = 10, threshold_pct: float = 80.0) -> DataFrame:
    """A-18: cumulative share curve over features sorted by score, with the top-k
    share and a flag when it reaches ``threshold_pct``. Input is a per-feature
    table (bounded by the number of features)."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.col(score_col).desc(), F.col(feature_col))
    wall = Window.partitionBy(F.lit(1))
    tot = F.sum(score_col).over(wall)
    curve = scores.select(feature_col, score_col, F.row_number().over(w).cast("long").alias("rank"),
                          (F.sum(score_col).over(w.rowsBetween(Window.unboundedPreceding, 0)) * 100.0 / tot)
                          .alias("cum_pct"), F.count(F.lit(1)).over(wall).alias("_n"))
    topk = F.max(F.when(F.col("rank") == F.least(F.lit(k), F.col("_n")), F.col("cum_pct"))).over(wall)
    return (curve.select("*", topk.alias("topk_pct"))
                 .select(feature_col, score_col, "rank", "cum_pct", "topk_pct",
                         (F.col("topk_pct") >= threshold_pct).alias("topk_dominant")))
