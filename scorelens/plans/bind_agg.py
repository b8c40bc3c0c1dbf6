"""Checked bindings for §2.4 (aggregation) on the W1 / W2 / RS views."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.operators import agg, stats
from scorelens.operators.derive import domain_prefix_tag
from scorelens.plans import views as V
from scorelens.plans.registry import register

W1 = f"({V.W1_SQL}) w1"
W2 = f"({V.W2_SQL}) w2"
RS = f"({V.RS_SQL}) rs"
GROUP = ["l_extendedprice", "o_totalprice", "p_retailprice"]
DOMAIN_MAP = {"l": "lineitem", "o": "orders", "c": "customer", "p": "part", "p_retail": "pricing"}


def _gm_sql(cols):
    return (f"(({' + '.join(f'coalesce(sum({c}), 0)' for c in cols)}) * 1e0 / "
            f"nullif({' + '.join(f'count({c})' for c in cols)}, 0))")


@register("class_distribution", dbl=["pct"], sql=f"""
SELECT grade, count(*) AS n, count(*) * 100e0 / sum(count(*)) OVER () AS pct FROM {W1} WHERE grade IS NOT NULL GROUP BY grade
""")
def q_class_distribution(spark, sf):
    return agg.class_distribution(V.w1(spark, sf), "grade")


@register("segment_kpi", dbl=["mean_target", "mean_group"], sql=" UNION ALL ".join(
    f"SELECT '{s}' AS segment, cast({s} AS varchar) AS level, count(*) AS n, avg(grade) AS mean_target, "
    f"{_gm_sql(GROUP)} AS mean_group FROM {W1} GROUP BY {s}" for s in V.SEGMENTS))
def q_segment_kpi(spark, sf):
    return agg.segment_kpi(V.w1(spark, sf), V.SEGMENTS, "grade", GROUP)


@register("trend_by_year", dbl=["mean_target", "mean_group"], sql=f"""
SELECT year, count(*) AS n, avg(grade) AS mean_target, {_gm_sql(GROUP)} AS mean_group FROM {W1} GROUP BY year
""")
def q_trend_by_year(spark, sf):
    return agg.trend_by_year(V.w1(spark, sf), "year", "grade", GROUP)


@register("class_profile", dbl=[f"mean_{c}" for c in V.FEATURES], sql=f"""
SELECT grade, count(*) AS n, {', '.join(f'avg({c}) AS mean_{c}' for c in V.FEATURES)} FROM {W1} GROUP BY grade
""")
def q_class_profile(spark, sf):
    return agg.class_profile(V.w1(spark, sf), "grade", V.FEATURES)


@register("own_domain_mean", dbl=["mean"], sql=" UNION ALL ".join(
    f"SELECT '{c.split('_', 1)[0]}' AS domain, '{c.split('_', 1)[1]}' AS part, '{c}' AS \"column\", "
    f"avg({c}) AS mean, count({c}) AS n FROM {W1}" for c in V.FEATURES))
def q_own_domain_mean(spark, sf):
    return agg.domain_part_means(V.w1(spark, sf), V.FEATURES)


@register("grade_share_by_segment", dbl=["pct_worst", "pct_high", "pct_top"], sql=f"""
SELECT area, count(*) AS n,
  avg(CASE WHEN grade = 1 THEN 1e0 ELSE 0e0 END) * 100 AS pct_worst,
  avg(CASE WHEN grade IN (4, 5) THEN 1e0 ELSE 0e0 END) * 100 AS pct_high,
  avg(CASE WHEN grade = 5 THEN 1e0 ELSE 0e0 END) * 100 AS pct_top
FROM {W1} GROUP BY area
""")
def q_grade_share(spark, sf):
    return agg.grade_share_by_segment(V.w1(spark, sf), "area", "grade")


@register("segment_summary", dbl=["mean", "std", "pct_high", "pct_low"], sql=f"""
SELECT product, cast(sum(c) AS bigint) AS n, sum(grade * c) * 1e0 / sum(c) AS mean,
  sqrt((sum(grade * grade * c) - sum(grade * c) * sum(grade * c) * 1e0 / sum(c)) / nullif(sum(c) - 1, 0)) AS std,
  sum(CASE WHEN grade IN (4, 5) THEN c ELSE 0 END) * 100e0 / sum(c) AS pct_high,
  sum(CASE WHEN grade IN (1, 2) THEN c ELSE 0 END) * 100e0 / sum(c) AS pct_low,
  string_agg(cast(grade AS varchar) || ':' || cast(c AS varchar), ', ' ORDER BY grade) AS distribution
FROM (SELECT product, grade, count(*) AS c FROM {W1} WHERE grade IS NOT NULL GROUP BY product, grade) t
GROUP BY product
""")
def q_segment_summary(spark, sf):
    return agg.segment_summary(V.w1(spark, sf), "product", "grade")


@register("crosstab_pct", dbl=[f"pct_{g}" for g in V.CLASSES], sql=f"""
SELECT client, {', '.join(f'sum(CASE WHEN grade = {g} THEN 1 ELSE 0 END) * 100e0 / count(*) AS pct_{g}' for g in V.CLASSES)}
FROM {W1} WHERE grade IS NOT NULL GROUP BY client
""")
def q_crosstab_pct(spark, sf):
    return agg.crosstab_pct(V.w1(spark, sf), "client", "grade", V.CLASSES)


@register("segment_feature_means", dbl=[f"mean_{c}" for c in V.FEATURES], sql=f"""
SELECT area, count(*) AS n, {', '.join(f'avg({c}) AS mean_{c}' for c in V.FEATURES)} FROM {W1} GROUP BY area
""")
def q_segment_feature_means(spark, sf):
    return agg.segment_feature_means(V.w1(spark, sf), "area", V.FEATURES)


_R = ", ".join(f"covar_samp({c}, grade) / nullif(stddev_samp({c}) * stddev_samp(grade), 0) AS r__{c}"
               for c in V.FEATURES)


@register("global_kpi", dbl=["mean_target", "mean_group", "pct_worst", "pct_top", "top_abs_r"], sql=f"""
WITH k AS (
  SELECT 17 AS n_cols, count(*) AS n_rows, avg(grade) AS mean_target, {_gm_sql(V.FEATURES)} AS mean_group,
    avg(CASE WHEN grade = 1 THEN 1e0 ELSE 0e0 END) * 100 AS pct_worst,
    avg(CASE WHEN grade = 5 THEN 1e0 ELSE 0e0 END) * 100 AS pct_top,
    {', '.join(f'count(DISTINCT {s}) AS n_{s}' for s in V.SEGMENTS)}, {_R}
  FROM {W1}),
 u AS (SELECT f, a FROM (SELECT {', '.join(f"abs(r__{c}) AS {c}" for c in V.FEATURES)} FROM k)
       UNPIVOT (a FOR f IN ({', '.join(V.FEATURES)})))
SELECT n_cols, n_rows, mean_target, mean_group, pct_worst, pct_top, {', '.join(f'n_{s}' for s in V.SEGMENTS)},
  (SELECT f FROM u ORDER BY a DESC, f DESC LIMIT 1) AS top_feature,
  (SELECT a FROM u ORDER BY a DESC, f DESC LIMIT 1) AS top_abs_r
FROM k
""")
def q_global_kpi(spark, sf):
    return agg.global_kpi(V.w1(spark, sf), "grade", V.SEGMENTS, V.FEATURES)


_KPI_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS segment, cast({s} AS varchar) AS level, avg(grade) AS mean_target FROM {W1} GROUP BY {s}"
    for s in V.SEGMENTS)


@register("best_worst_segment", dbl=["best_mean", "worst_mean"], sql=f"""
WITH k AS ({_KPI_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY mean_target DESC, level) AS rb,
               row_number() OVER (PARTITION BY segment ORDER BY mean_target ASC, level) AS rw FROM k)
SELECT segment, max(CASE WHEN rb = 1 THEN level END) AS best_level, max(CASE WHEN rb = 1 THEN mean_target END) AS best_mean,
       max(CASE WHEN rw = 1 THEN level END) AS worst_level, max(CASE WHEN rw = 1 THEN mean_target END) AS worst_mean
FROM r GROUP BY segment
""")
def q_best_worst(spark, sf):
    return agg.best_worst_segment(agg.segment_kpi(V.w1(spark, sf), V.SEGMENTS, "grade", GROUP))


@register("grade_gap", dbl=["mean_low", "mean_high", "gap"], sql=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(CASE WHEN grade = 1 THEN {c} END) AS mean_low, "
    f"avg(CASE WHEN grade = 5 THEN {c} END) AS mean_high, "
    f"avg(CASE WHEN grade = 1 THEN {c} END) - avg(CASE WHEN grade = 5 THEN {c} END) AS gap FROM {W1}"
    for c in V.FEATURES))
def q_grade_gap(spark, sf):
    return agg.grade_gap(V.w1(spark, sf), "grade", V.FEATURES)


@register("top_k", dbl=["l_extendedprice"], sql=f"""
SELECT row_key, grade, l_extendedprice FROM {W1} ORDER BY l_extendedprice DESC, row_key LIMIT 10
""")
def q_top_k(spark, sf):
    return agg.top_k(V.w1(spark, sf).select("row_key", "grade", "l_extendedprice"),
                     "l_extendedprice", 10, tie_break=["row_key"])


def _feature_abs_r(spark, sf):
    return stats.corr_with_target(V.w1(spark, sf), V.FEATURES, "grade").select(
        "feature", F.col("abs_r").alias("score"))


_ABS_R_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(covar_samp({c}, grade) / nullif(stddev_samp({c}) * stddev_samp(grade), 0)) AS score "
    f"FROM {W1}" for c in V.FEATURES)


def _domain_case(col: str) -> str:
    items = sorted(DOMAIN_MAP.items(), key=lambda kv: -len(kv[0]))
    whens = " ".join(f"WHEN {col} = '{p}' OR starts_with({col}, '{p}_') THEN '{d}'" for p, d in items)
    return f"(CASE {whens} ELSE 'other' END)"


@register("domain_score_rollup", dbl=["score_sum", "share_pct"], sql=f"""
WITH s AS ({_ABS_R_SQL}),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, feature) AS rk FROM s),
g AS (SELECT {_domain_case('feature')} AS domain, count(*) AS n_features, sum(score) AS score_sum FROM t WHERE rk <= 5 GROUP BY 1)
SELECT domain, n_features, score_sum, score_sum * 100e0 / sum(score_sum) OVER () AS share_pct FROM g
""")
def q_domain_score_rollup(spark, sf):
    scores = domain_prefix_tag(_feature_abs_r(spark, sf), "feature", DOMAIN_MAP)
    return agg.domain_score_rollup(scores, "domain", "score", "feature", k=5)


_SPLIT = "CASE WHEN substr(md5(row_key), 1, 1) IN ('0', '1', '2') THEN 'test' ELSE 'train' END"


@register("dataset_meta", dbl=["share"], sql=f"""
WITH d AS (SELECT {_SPLIT} AS split, grade, area FROM {W1}),
pc AS (SELECT split, grade, count(*) AS c FROM d GROUP BY split, grade),
per AS (SELECT split, sum(c) AS n_rows, count(*) AS n_classes,
        string_agg(cast(grade AS varchar) || ':' || cast(c AS varchar), ',' ORDER BY grade) AS class_counts
        FROM pc GROUP BY split),
lv AS (SELECT split, string_agg(DISTINCT area, ',' ORDER BY area) AS levels FROM d GROUP BY split)
SELECT per.split, cast(n_rows AS bigint) AS n_rows, n_rows * 1e0 / sum(n_rows) OVER () AS share, n_classes, class_counts, levels
FROM per JOIN lv ON per.split = lv.split
""")
def q_dataset_meta(spark, sf):
    d = V.w1(spark, sf).select(F.expr(_SPLIT).alias("split"), "grade", "area")
    return agg.dataset_meta(d, "split", "grade", "area")


@register("pivot_mean_matrix", dbl=V.RS_METRICS, sql=f"""
SELECT model, {', '.join(f"avg(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in V.RS_METRICS)}
FROM {RS} GROUP BY model
""")
def q_pivot_mean_matrix(spark, sf):
    return agg.pivot_mean_matrix(V.rs_view(spark, sf), "model", "metric", "value", V.RS_METRICS)


@register("argmax_by", dbl=["mean_value"], sql=f"""
WITH m AS (SELECT metric, model, avg(value) AS mean_value FROM {RS} GROUP BY metric, model),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'mae' THEN mean_value ELSE -mean_value END, model) AS rn FROM m)
SELECT metric, model AS best_model, mean_value FROM r WHERE rn = 1
""")
def q_argmax_by(spark, sf):
    rs = V.rs_view(spark, sf)
    acc = agg.argmax_by(rs.where("metric = 'accuracy'"), "metric", "model", "value", True)
    mae = agg.argmax_by(rs.where("metric = 'mae'"), "metric", "model", "value", False)
    return acc.unionByName(mae)


_W2_ABS_R = (f"SELECT feature, abs(covar_samp(value, label) / nullif(stddev_samp(value) * stddev_samp(label), 0)) AS score "
             f"FROM (UNPIVOT (SELECT label, {', '.join(f'e{i}' for i in range(V.EMB_DIM))} FROM {W2}) "
             f"ON {', '.join(f'e{i}' for i in range(V.EMB_DIM))} INTO NAME feature VALUE value) GROUP BY feature")


@register("cumulative_share", dbl=["score", "cum_pct", "topk_pct"], sql=f"""
WITH s AS ({_W2_ABS_R}),
c AS (SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature) AS rank,
      sum(score) OVER (ORDER BY score DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100e0
        / sum(score) OVER () AS cum_pct FROM s)
SELECT feature, score, rank, cum_pct, max(CASE WHEN rank = least(10, cnt) THEN cum_pct END) OVER () AS topk_pct,
       max(CASE WHEN rank = least(10, cnt) THEN cum_pct END) OVER () >= 80 AS topk_dominant FROM (SELECT *, count(*) OVER () AS cnt FROM c) c2
""")
def q_cumulative_share(spark, sf):
    w2 = V.w2(spark, sf)
    scores = stats.corr_with_target(w2, [f"e{i}" for i in range(V.EMB_DIM)], "label").select(
        "feature", F.col("abs_r").alias("score"))
    return agg.cumulative_share(scores, "feature", "score", k=10)
