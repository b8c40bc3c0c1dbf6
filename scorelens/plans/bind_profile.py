"""Checked bindings for §2.3 (profiling, data quality)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.operators import agg, profile
from scorelens.plans import views as V
from scorelens.plans.registry import register

W1 = f"({V.W1_SQL}) w1"
W1N = f"({V.W1N_SQL}) w1n"
FE = V.FEATURES
FL = ", ".join(FE)
LONG_N = f"(SELECT * FROM (SELECT {FL} FROM {W1N}) t UNPIVOT INCLUDE NULLS (value FOR feature IN ({FL})))"
W1_TYPES = [("row_key", "string"), ("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_partkey", "bigint"),
            ("grade", "int"), ("year", "int"), ("area", "string"), ("product", "string"), ("client", "string")] + \
           [(c, "double") for c in FE]


@register("profile_columns", dbl=["mean", "std", "min", "p25", "median", "p75", "max", "null_pct"], sql=f"""
SELECT feature, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
  quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75,
  max(value) AS max, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) * 100e0 / count(*) AS null_pct
FROM {LONG_N} GROUP BY feature
""")
def q_profile_columns(spark, sf):
    return profile.profile_columns(V.w1n(spark, sf), FE)


_MISS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", cast(count(*) - count({c}) AS bigint) AS null_count, "
    f"(count(*) - count({c})) * 100e0 / count(*) AS null_pct, '{t}' AS dtype FROM {W1N}" for c, t in W1_TYPES)


@register("missing_summary", dbl=["null_pct"], sql=_MISS)
def q_missing_summary(spark, sf):
    return profile.missing_summary(V.w1n(spark, sf))


@register("null_cell_count", sql=f"SELECT cast(sum(null_count) AS bigint) AS null_cells FROM ({_MISS}) m")
def q_null_cells(spark, sf):
    return profile.null_cell_count(V.w1n(spark, sf))


@register("duplicate_rows", sql=f"""
SELECT cast(coalesce(sum(c - 1), 0) AS bigint) AS duplicate_rows, count(*) AS distinct_rows
FROM (SELECT *, count(*) AS c FROM {W1} GROUP BY ALL) g
""")
def q_duplicate_rows(spark, sf):
    return profile.duplicate_rows(V.w1(spark, sf))


@register("constant_columns", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", (min({c}) IS NULL OR min({c}) = max({c})) AS is_constant FROM "
    f"(SELECT *, 'x' AS const_tag FROM {W1}) w" for c, _ in W1_TYPES + [("const_tag", "string")]))
def q_constant_columns(spark, sf):
    return profile.constant_columns(V.w1(spark, sf).withColumn("const_tag", F.lit("x")))


_DC = ["area", "product", "client", "grade", "year", "l_quantity", "p_size"]


@register("distinct_counts", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM {W1}" for c in _DC))
def q_distinct_counts(spark, sf):
    return profile.distinct_counts(V.w1(spark, sf), _DC)


@register("value_range_topk", dbl=["value_range"], sql=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, max({c}) - min({c}) AS value_range FROM {W1}" for c in FE)
    .join(["SELECT * FROM (", ") v ORDER BY value_range DESC, feature LIMIT 5"]))
def q_value_range_topk(spark, sf):
    return profile.value_range_topk(V.w1(spark, sf), FE, 5)


@register("range_check", dbl=["observed_min", "observed_max", "lower", "upper"], sql=f"""
SELECT least(min(l_discount), min(l_tax)) AS observed_min, greatest(max(l_discount), max(l_tax)) AS observed_max,
  0e0 AS lower, 0.1e0 AS upper,
  least(min(l_discount), min(l_tax)) >= 0 AND greatest(max(l_discount), max(l_tax)) <= 0.1 AS within_bounds
FROM {W1}
""")
def q_range_check(spark, sf):
    return profile.range_check(V.w1(spark, sf), ["l_discount", "l_tax"], 0.0, 0.1)


@register("class_imbalance", dbl=["ratio"], sql=f"""
SELECT count(*) AS n_classes, max(n) AS max_count, min(n) AS min_count, max(n) * 1e0 / min(n) AS ratio,
  CASE WHEN max(n) * 1e0 / min(n) > 10 THEN 'severe' WHEN max(n) * 1e0 / min(n) > 3 THEN 'moderate' ELSE 'balanced' END AS verdict
FROM (SELECT area, count(*) AS n FROM {W1} GROUP BY area) c
""")
def q_class_imbalance(spark, sf):
    return profile.class_imbalance(V.w1(spark, sf), "area")


@register("column_shape_stats", dbl=["missing_rate", "cv", "iqr", "outlier_rate", "skew"], sql=f"""
WITH s AS (SELECT feature, count(*) AS n_all, count(value) AS n, avg(value) AS mu, stddev_samp(value) AS sd,
             skewness(value) AS sk, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {LONG_N} GROUP BY feature),
b AS (SELECT *, CASE WHEN q3 > q1 THEN q3 - q1 ELSE sd + 1e-9 END AS iqr FROM s),
f AS (SELECT *, q1 - 1.5 * iqr AS lo, q3 + 1.5 * iqr AS hi FROM b),
o AS (SELECT l.feature, sum(CASE WHEN value < lo OR value > hi THEN 1 ELSE 0 END) AS n_out
      FROM {LONG_N} l JOIN f ON l.feature = f.feature WHERE value IS NOT NULL GROUP BY l.feature)
SELECT f.feature, (n_all - n) * 1e0 / n_all AS missing_rate,
  CASE WHEN n >= 5 THEN (sd + 1e-9) / (abs(mu) + 1e-6) END AS cv,
  CASE WHEN n >= 5 THEN iqr END AS iqr,
  CASE WHEN n >= 5 THEN n_out * 1e0 / n END AS outlier_rate,
  CASE WHEN n >= 5 THEN sk END AS skew
FROM f LEFT JOIN o ON f.feature = o.feature
""")
def q_column_shape(spark, sf):
    return profile.column_shape_stats(V.w1n(spark, sf), FE)


@register("axis_bounds", dbl=["axis_min", "axis_max"], sql=f"""
WITH y AS (SELECT year, avg(grade) AS m FROM {W1} GROUP BY year),
b AS (SELECT min(m) AS lo, max(m) AS hi FROM y)
SELECT lo - CASE WHEN hi <> lo THEN hi - lo ELSE 1 END * 0.1 AS axis_min,
       hi + CASE WHEN hi <> lo THEN hi - lo ELSE 1 END * 0.1 AS axis_max FROM b
""")
def q_axis_bounds(spark, sf):
    t = agg.trend_by_year(V.w1(spark, sf), "year", "grade", ["l_extendedprice"])
    return profile.axis_bounds(t, ["mean_target"], margin=0.1)


_HIST_COLS = ["l_quantity", "l_extendedprice"]


@register("histogram_by_class", dbl=["bin_start", "bin_end"], sql=f"""
WITH l AS (SELECT * FROM (UNPIVOT (SELECT grade, {', '.join(_HIST_COLS)} FROM {W1}) ON {', '.join(_HIST_COLS)}
           INTO NAME feature VALUE value) u WHERE value IS NOT NULL),
mm AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature),
b AS (SELECT l.feature, grade, lo, CASE WHEN hi > lo THEN (hi - lo) / 10 ELSE 1e0 END AS width FROM l JOIN mm ON l.feature = mm.feature),
c AS (SELECT feature, grade, lo, width, cast(least(floor((value - lo) / width), 9) AS int) AS bin
      FROM (SELECT l.feature, grade, value, lo, CASE WHEN hi > lo THEN (hi - lo) / 10 ELSE 1e0 END AS width
            FROM l JOIN mm ON l.feature = mm.feature) x)
SELECT feature, grade, bin, lo + bin * width AS bin_start, lo + (bin + 1) * width AS bin_end, count(*) AS count
FROM c GROUP BY feature, grade, bin, lo, width
""")
def q_histogram(spark, sf):
    return profile.histogram_by_class(V.w1(spark, sf), _HIST_COLS, bins=10, class_col="grade")


@register("box_stats_by_class", dbl=["q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi"], sql=f"""
WITH q AS (SELECT grade, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM {W1} GROUP BY grade),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS flo, q3 + 1.5 * (q3 - q1) AS fhi FROM q)
SELECT f.grade, n, q1, median, q3, iqr,
  min(CASE WHEN l_extendedprice BETWEEN flo AND fhi THEN l_extendedprice END) AS whisker_lo,
  max(CASE WHEN l_extendedprice BETWEEN flo AND fhi THEN l_extendedprice END) AS whisker_hi,
  cast(sum(CASE WHEN l_extendedprice BETWEEN flo AND fhi THEN 0 ELSE 1 END) AS bigint) AS n_outliers
FROM {W1} JOIN f ON w1.grade = f.grade GROUP BY f.grade, n, q1, median, q3, iqr
""")
def q_box_stats(spark, sf):
    return profile.box_stats_by_class(V.w1(spark, sf), "l_extendedprice", "grade")


@register("kde_density", dbl=["x", "density"], sql=f"""
WITH d AS (SELECT grade, l_extendedprice AS v FROM {W1} WHERE l_extendedprice IS NOT NULL),
st AS (SELECT grade, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd, count(*) AS n FROM d GROUP BY grade),
st2 AS (SELECT *, sd * pow(n * 1e0, -0.2e0) AS h, CASE WHEN hi > lo THEN (hi - lo) / 512 ELSE 1e0 END AS bw FROM st),
hist AS (SELECT d.grade, cast(least(floor((v - lo) / bw), 511) AS int) AS b, count(*) AS c
         FROM d JOIN st2 ON d.grade = st2.grade GROUP BY d.grade, 2),
pts AS (SELECT hist.grade, c, n, h, lo + (b + 0.5e0) * bw AS center, g,
               lo + g * CASE WHEN hi > lo THEN (hi - lo) / 49 ELSE 0e0 END AS x
        FROM hist JOIN st2 ON hist.grade = st2.grade, range(0, 50) r(g))
SELECT grade, cast(g AS int) AS g, any_value(x) AS x,
       sum(c * exp(-0.5e0 * ((x - center) / h) * ((x - center) / h)) / (n * h * sqrt(2 * pi()))) AS density
FROM pts GROUP BY grade, g
""")
def q_kde(spark, sf):
    return profile.kde_density(V.w1(spark, sf), "l_extendedprice", "grade", grid=50, fine_bins=512)
