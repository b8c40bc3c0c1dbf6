"""Checked bindings for §2.5 (correlation, rank statistics, tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.functions import pvalues as PV
from scorelens.operators import stats
from scorelens.operators.stats import wilcoxon_normal_p_sql
from scorelens.plans import views as V
from scorelens.plans.helpers import to_long
from scorelens.plans.registry import register

W1 = f"({V.W1_SQL}) w1"
W1N = f"({V.W1N_SQL}) w1n"
RS = f"({V.RS_SQL}) rs"
FE = V.FEATURES
FL = ", ".join(FE)
LONG = f"(UNPIVOT (SELECT grade, {FL} FROM {W1}) ON {FL} INTO NAME feature VALUE value)"
RS_BY = ["condition", "metric"]


def _r(x, y):
    return f"(covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0))"


def _avg_rank_sql(part: str, order: str) -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {order}) + "
            f"(count(*) OVER (PARTITION BY {part}, {order}) - 1) / 2e0)")


# ------------------------------------------------------------------ T-01..T-03
@register("corr_with_target", dbl=["r", "abs_r"], sql=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_r(c, f'CASE WHEN {c} IS NOT NULL THEN grade END')} AS r, "
    f"abs({_r(c, f'CASE WHEN {c} IS NOT NULL THEN grade END')}) AS abs_r, count({c}) AS n FROM {W1N}" for c in FE))
def q_corr_with_target(spark, sf):
    return stats.corr_with_target(V.w1n(spark, sf), FE, "grade")


_PAIRS = [(a, b) for i, a in enumerate(FE) for b in FE[i + 1:]]
_PAIR_SQL = " UNION ALL ".join(
    [f"SELECT '{a}' AS var1, '{b}' AS var2, {_r(a, b)} AS r FROM {W1}" for a, b in _PAIRS]
    + [f"SELECT '{b}' AS var1, '{a}' AS var2, {_r(a, b)} AS r FROM {W1}" for a, b in _PAIRS]
    + [f"SELECT '{c}' AS var1, '{c}' AS var2, 1e0 AS r" for c in FE])
_ABS_R = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs({_r(c, 'grade')}) AS a FROM {W1}" for c in FE)


@register("corr_matrix_topn", dbl=["r"], sql=f"""
WITH t AS (SELECT feature FROM ({_ABS_R}) s ORDER BY a DESC NULLS LAST, feature LIMIT 4),
m AS ({_PAIR_SQL})
SELECT var1, var2, r FROM m WHERE var1 IN (SELECT feature FROM t) AND var2 IN (SELECT feature FROM t)
""")
def q_corr_matrix_topn(spark, sf):
    return stats.corr_matrix_topn(V.w1(spark, sf), FE, "grade", 4)


# the scores and three sums of them, so that there are collinear pairs to find
_SUMS = {"net": "l_extendedprice * (1 - l_discount)", "gross": "l_extendedprice * (1 + l_tax)", "stock": "l_quantity + l_tax"}
_W1S = "(SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _SUMS.items()) + f" FROM {W1}) w1s"
_FES = FE + list(_SUMS)


@register("collinear_pairs", dbl=["correlation"], sql=" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{a}' AS var1, '{b}' AS var2, {_r(a, b)} AS correlation FROM {_W1S}) p{i} "
    f"WHERE abs(correlation) >= 0.9" for i, (a, b) in enumerate((a, b) for k, a in enumerate(_FES) for b in _FES[k + 1:])))
def q_collinear_pairs(spark, sf):
    return stats.collinear_pairs(V.w1(spark, sf).withColumns({n: F.expr(e) for n, e in _SUMS.items()}), _FES, 0.9)


# ------------------------------------------------------------------ T-04 / T-05
# the p-value (Student t, no closed form in SQL) is checked in tests
@register("spearman_corr", dbl=["rho", "t_stat"], sql=f"""
WITH rk AS (SELECT feature, {_avg_rank_sql('feature', 'value')} AS rx, {_avg_rank_sql('feature', 'grade')} AS ry
            FROM {LONG} WHERE grade IS NOT NULL),
s AS (SELECT feature, {_r('rx', 'ry')} AS rho, count(*) AS n FROM rk GROUP BY feature)
SELECT feature, rho, n, rho * sqrt((n - 2) / nullif(1 - rho * rho, 0)) AS t_stat FROM s
""")
def q_spearman(spark, sf):
    return stats.spearman_with_target(V.w1(spark, sf), FE, "grade").drop("p_value")


@register("average_rank", dbl=["l_extendedprice", "rank"], sql=f"""
SELECT row_key, area, l_extendedprice, {_avg_rank_sql('area', 'l_extendedprice')} AS rank FROM {W1}
""")
def q_average_rank(spark, sf):
    d = V.w1(spark, sf).select("row_key", "area", "l_extendedprice")
    return stats.average_rank(d, "l_extendedprice", ["area"])


# ------------------------------------------------------------------ T-06 / T-07
_KW_SQL = f"""
WITH long AS (SELECT * FROM {LONG} WHERE grade IS NOT NULL),
sizes AS (SELECT feature, grade, count(*) AS nj FROM long GROUP BY feature, grade),
kept AS (SELECT l.* FROM long l JOIN sizes s ON l.feature = s.feature AND l.grade = s.grade WHERE s.nj >= 3),
rk AS (SELECT feature, grade, {_avg_rank_sql('feature', 'value')} AS r FROM kept),
ties AS (SELECT feature, sum(t * t * t * 1e0 - t) AS ts, sum(t) AS nn
         FROM (SELECT feature, value, count(*) AS t FROM kept GROUP BY feature, value) tv GROUP BY feature),
rj AS (SELECT feature, grade, sum(r) AS rr, count(*) AS nj FROM rk GROUP BY feature, grade),
per AS (SELECT feature, sum(rr * rr / nj) AS s, count(*) AS k FROM rj GROUP BY feature),
h AS (SELECT per.feature, k, cast(nn AS bigint) AS n,
      CASE WHEN k >= 2 THEN (12e0 / (nn * (nn + 1)) * s - 3 * (nn + 1)) / nullif(1 - ts / (nn * nn * nn - nn), 0) END AS h
      FROM per JOIN ties ON per.feature = ties.feature),
hp AS (SELECT *, {PV.chi2_sf_sql('h', '(k - 1)')} AS p_value FROM h)
SELECT feature, k, n, h, p_value,
       CASE WHEN h IS NOT NULL THEN greatest((h - k + 1) / nullif(n - k, 0), 0e0) END AS eta2,
       p_value < 0.05 AS significant FROM hp
"""


@register("kruskal_wallis", dbl=["h", "p_value", "eta2"], sql=_KW_SQL)
def q_kruskal(spark, sf):
    return stats.kruskal_wallis(V.w1(spark, sf), FE, "grade")


@register("kw_screen", dbl=["pct_significant"], sql=f"""
WITH kw AS ({_KW_SQL}),
r AS (SELECT *, row_number() OVER (ORDER BY eta2 DESC NULLS LAST, feature) AS rn FROM kw)
SELECT count(*) AS n_features, cast(sum(CASE WHEN p_value < 0.05 THEN 1 ELSE 0 END) AS bigint) AS n_significant,
  avg(CASE WHEN p_value < 0.05 THEN 1e0 ELSE 0e0 END) * 100 AS pct_significant,
  coalesce(string_agg(CASE WHEN rn <= 5 THEN feature END, ',' ORDER BY rn), '') AS top_features,
  coalesce(string_agg(CASE WHEN eta2 < 0.01 AND p_value >= 0.05 THEN feature END, ',' ORDER BY feature), '') AS weak_features
FROM r
""")
def q_kw_screen(spark, sf):
    return stats.kw_screen(stats.kruskal_wallis(V.w1(spark, sf), FE, "grade"))


# ------------------------------------------------------------------ T-08 / T-09
@register("mann_whitney_u", dbl=["u", "z", "p_value"], sql=f"""
WITH rk AS (SELECT feature, grade, {_avg_rank_sql('feature', 'value')} AS r FROM {LONG} WHERE grade IS NOT NULL),
ties AS (SELECT feature, sum(t * t * t * 1e0 - t) AS ts FROM
         (SELECT feature, value, count(*) AS t FROM {LONG} WHERE grade IS NOT NULL GROUP BY feature, value) x GROUP BY feature),
s AS (SELECT feature, sum(CASE WHEN grade = 1 THEN r ELSE 0 END) AS r1,
             sum(CASE WHEN grade = 1 THEN 1 ELSE 0 END) * 1e0 AS n1, sum(CASE WHEN grade = 1 THEN 0 ELSE 1 END) * 1e0 AS n2
      FROM rk GROUP BY feature),
u AS (SELECT s.feature, n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 2 AS mu,
             sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ts / ((n1 + n2) * (n1 + n2 - 1)))) AS sigma
      FROM s JOIN ties ON s.feature = ties.feature)
SELECT feature, cast(n1 AS bigint) AS n1, cast(n2 AS bigint) AS n2, u,
       ((u - mu - 0.5e0) / nullif(sigma, 0)) AS z, {PV.norm_sf_sql('((u - mu - 0.5e0) / nullif(sigma, 0))')} AS p_value
FROM u
""")
def q_mann_whitney(spark, sf):
    long = to_long(V.w1(spark, sf), FE, ["grade"])
    return stats.mann_whitney_u(long, "value", "grade", 1, by=["feature"])


@register("welch_t", dbl=["m1", "m2", "t_stat", "dof"], sql=f"""
WITH s AS (SELECT feature,
  avg(CASE WHEN grade = 1 THEN value END) AS m1, avg(CASE WHEN grade <> 1 THEN value END) AS m2,
  var_samp(CASE WHEN grade = 1 THEN value END) AS v1, var_samp(CASE WHEN grade <> 1 THEN value END) AS v2,
  count(CASE WHEN grade = 1 THEN value END) AS n1, count(CASE WHEN grade <> 1 THEN value END) AS n2
  FROM {LONG} WHERE grade IS NOT NULL GROUP BY feature)
SELECT feature, n1, n2, m1, m2, (m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0) AS t_stat,
  (v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / nullif((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1), 0) AS dof
FROM s
""")
def q_welch(spark, sf):
    long = to_long(V.w1(spark, sf), FE, ["grade"])
    return stats.welch_t(long, "value", "grade", 1, by=["feature"], with_p=False)


# ------------------------------------------------------------- Friedman family
def _friedman_sql(src: str, by: list[str], block: str, treat: str, value: str) -> str:
    b = ", ".join(by)
    jb = " AND ".join(f"x.{c} = y.{c}" for c in by)
    return f"""
WITH s AS (SELECT * FROM {src} WHERE {value} IS NOT NULL),
k_all AS (SELECT {b}, count(DISTINCT {treat}) AS k FROM s GROUP BY {b}),
bsz AS (SELECT {b}, {block}, count(*) AS bk FROM s GROUP BY {b}, {block}),
fullb AS (SELECT x.* FROM bsz x JOIN k_all y ON {jb} WHERE x.bk = y.k),
s2 AS (SELECT x.* FROM s x JOIN fullb y ON {jb} AND x.{block} = y.{block}),
r AS (SELECT *, {_avg_rank_sql(f'{b}, {block}', value)} AS rk,
             count(*) OVER (PARTITION BY {b}, {block}, {value}) AS tie FROM s2),
rj AS (SELECT {b}, {treat}, sum(rk) AS rr FROM r GROUP BY {b}, {treat}),
tie AS (SELECT {b}, sum(t * t * t * 1e0 - t) AS tie_sum, count(DISTINCT {block}) AS n
        FROM (SELECT {b}, {block}, {value}, any_value(tie) AS t FROM r GROUP BY {b}, {block}, {value}) tt GROUP BY {b}),
ag AS (SELECT {b}, sum(rr * rr) AS sr2, count(*) AS k FROM rj GROUP BY {b}),
j AS (SELECT x.*, y.tie_sum, y.n FROM ag x JOIN tie y ON {jb}),
c AS (SELECT {b}, k, n,
  CASE WHEN k >= 3 AND n >= 3 THEN (12e0 / (n * k * (k + 1)) * sr2 - 3 * n * (k + 1)) / nullif(1 - tie_sum / (n * k * (k * k - 1)), 0) END AS chi2,
  CASE WHEN NOT (k >= 3 AND n >= 3) THEN 'need k >= 3 and n >= 3' END AS note FROM j)
SELECT *, {PV.chi2_sf_sql('chi2', '(k - 1)')} AS p_value FROM c
"""


@register("friedman_test", dbl=["chi2", "p_value"], sql=_friedman_sql(RS, RS_BY, "seed", "model", "value"))
def q_friedman(spark, sf):
    return stats.friedman_test(V.rs_view(spark, sf), "seed", "model", "value", by=RS_BY)


# importance-like table from the data: |r| of feature with grade per (client, year)
def _imp(spark, sf):
    long = to_long(V.w1(spark, sf), FE, ["grade", "client", "year"])
    return (long.groupBy("feature", "client", "year")
                .agg(F.abs(stats._pearson(F.col("value"), F.col("grade").cast("double"))).alias("imp")))


_IMP_SQL = (f"(SELECT feature, client, year, abs({_r('value', 'grade')}) AS imp FROM "
            f"(UNPIVOT (SELECT grade, client, year, {FL} FROM {W1}) ON {FL} INTO NAME feature VALUE value) l "
            f"GROUP BY feature, client, year)")


@register("friedman_per_feature", dbl=["chi2", "p_value", "p_adj"], sql=f"""
WITH f AS ({_friedman_sql(_IMP_SQL, ['feature'], 'year', 'client', 'imp')})
SELECT *, least(p_value * count(*) OVER (), 1e0) AS p_adj, least(p_value * count(*) OVER (), 1e0) < 0.05 AS significant FROM f
""")
def q_friedman_per_feature(spark, sf):
    return stats.friedman_per_feature(_imp(spark, sf), "feature", "client", "year", "imp")


@register("kendall_w", dbl=["w", "chi2", "p_value"], sql=f"""
WITH rt AS (SELECT year, product, avg(l_extendedprice) AS v FROM {W1} GROUP BY year, product),
r AS (SELECT product, {_avg_rank_sql('year', 'v')} AS rk FROM rt),
ri AS (SELECT product, sum(rk) AS rr FROM r GROUP BY product),
s AS (SELECT count(*) AS n, sum(rr) AS sr, sum(rr * rr) AS sr2 FROM ri),
k AS (SELECT count(DISTINCT year) AS k FROM rt),
w AS (SELECT k, n, 12 * (sr2 - sr * sr / n) / (k * k * (n * n * n * 1e0 - n) + 1e-15) AS w FROM s, k),
c AS (SELECT *, k * (n - 1) * w AS chi2 FROM w)
SELECT *, {PV.chi2_sf_sql('chi2', '(n - 1)')} AS p_value FROM c
""")
def q_kendall(spark, sf):
    rt = V.w1(spark, sf).groupBy("year", "product").agg(F.avg("l_extendedprice").alias("v"))
    return stats.kendall_w(rt, "year", "product", "v")


# ------------------------------------------------------------- Wilcoxon family
def _signed_rank_sql(src_d: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""
allk AS (SELECT {k}, count(*) AS n_pairs FROM {src_d} GROUP BY {k}),
nz AS (SELECT * FROM {src_d} WHERE d IS NOT NULL AND d <> 0),
rk AS (SELECT {k}, d, {_avg_rank_sql(k, 'abs(d)')} AS rk, count(*) OVER (PARTITION BY {k}, abs(d)) AS t FROM nz),
sr AS (SELECT {k}, sum(CASE WHEN d > 0 THEN rk ELSE 0e0 END) AS w_plus, sum(CASE WHEN d < 0 THEN rk ELSE 0e0 END) AS w_minus,
       count(*) AS n, max(t) AS max_tie, sum(t * t * 1e0 - 1) AS tie_term FROM rk GROUP BY {k}),
st AS (SELECT a.*, coalesce(sr.n, 0) AS n, coalesce(w_plus, 0e0) AS w_plus, coalesce(w_minus, 0e0) AS w_minus,
       coalesce(max_tie, 1) AS max_tie, coalesce(tie_term, 0e0) AS tie_term
       FROM allk a LEFT JOIN sr USING ({k}))"""


def _exact_p_sql(alternative: str) -> str:
    """Exact signed-rank p by enumerating all 2^n sign vectors (n <= 20)."""
    stat = ("least(st.w_plus, st.n * (st.n + 1) / 2e0 - st.w_plus)" if alternative == "two-sided"
            else "st.w_plus")
    cmp_ = "<=" if alternative == "two-sided" else ">="
    scale = "2e0 * " if alternative == "two-sided" else ""
    return f"""(SELECT least(1e0, {scale}count(*) / pow(2e0, st.n)) FROM dist
               WHERE dist.n = st.n AND dist.s {cmp_} {stat})"""


def _wilcoxon_tail(alternative: str) -> str:
    return f"""
nset AS (SELECT DISTINCT n FROM st WHERE n BETWEEN 1 AND 20),
dist AS (SELECT n, list_sum(list_transform(range(n), lambda i: ((mask >> i) & 1) * (i + 1))) AS s
         FROM nset, range(0, 1048576) t(mask) WHERE mask < (1 << n)),
pv AS (SELECT st.*, CASE WHEN st.n = 0 THEN 1e0
         WHEN st.n = st.n_pairs AND st.max_tie <= 1 AND st.n <= 50 THEN {_exact_p_sql(alternative)}
         ELSE {wilcoxon_normal_p_sql(alternative, 'st.')} END AS p_value FROM st)"""


RS_RAW = f"({V.RS_SQL})"
_WPAIR_D = (f"(SELECT x.condition, x.metric, x.model AS a, y.model AS b, x.seed, x.value - y.value AS d "
            f"FROM {RS_RAW} x JOIN {RS_RAW} y ON x.condition = y.condition AND x.metric = y.metric AND x.seed = y.seed "
            f"WHERE x.model < y.model)")


@register("wilcoxon_pairs", dbl=["w_plus", "w_minus", "tie_term", "w", "p_value", "p_adj"], sql=f"""
WITH {_signed_rank_sql(_WPAIR_D, ['condition', 'metric', 'a', 'b'])},
{_wilcoxon_tail('two-sided')}
SELECT *, least(w_plus, w_minus) AS w, least(p_value * count(*) OVER (PARTITION BY condition, metric), 1e0) AS p_adj,
       least(p_value * count(*) OVER (PARTITION BY condition, metric), 1e0) < 0.05 AS significant FROM pv
""")
def q_wilcoxon_pairs(spark, sf):
    return stats.wilcoxon_pairs(V.rs_view(spark, sf), "seed", "model", "value", by=RS_BY)


_WBASE_D = (f"(SELECT x.condition, x.metric, x.model, x.seed, x.value - y.value AS d "
            f"FROM {RS_RAW} x JOIN {RS_RAW} y ON x.condition = y.condition AND x.metric = y.metric AND x.seed = y.seed "
            f"WHERE y.model = 'm1' AND x.model <> 'm1')")


@register("wilcoxon_vs_baseline", dbl=["w_plus", "w_minus", "tie_term", "w", "p_value", "p_adj"], sql=f"""
WITH {_signed_rank_sql(_WBASE_D, ['condition', 'metric', 'model'])},
{_wilcoxon_tail('two-sided')},
q AS (SELECT pv.* REPLACE (CASE WHEN n_pairs >= 3 AND n > 0 THEN p_value END AS p_value),
      CASE WHEN n_pairs >= 3 AND n > 0 THEN least(w_plus, w_minus) END AS w FROM pv)
SELECT *, least(p_value * count(p_value) OVER (), 1e0) AS p_adj, least(p_value * count(p_value) OVER (), 1e0) < 0.05 AS significant FROM q
""")
def q_wilcoxon_vs_baseline(spark, sf):
    return stats.wilcoxon_vs_baseline(V.rs_view(spark, sf), "seed", "model", "value", "m1", by=RS_BY)


_WGT_D = (f"(SELECT feature, year, {_r('value', 'grade')} AS d FROM "
          f"(UNPIVOT (SELECT grade, year, {FL} FROM {W1}) ON {FL} INTO NAME feature VALUE value) l GROUP BY feature, year)")


@register("wilcoxon_gt_zero", dbl=["w_plus", "p_value", "min_attainable_p"], sql=f"""
WITH {_signed_rank_sql(_WGT_D, ['feature'])},
{_wilcoxon_tail('greater')},
mm AS (SELECT feature, min(d) AS mn, max(d) AS mx FROM {_WGT_D} g GROUP BY feature),
q AS (SELECT pv.feature, n, w_plus,
        CASE WHEN n = 0 THEN 1e0 WHEN mn = mx AND mn > 0 THEN 0e0 ELSE p_value END AS p_value,
        pow(0.5e0, n) AS min_attainable_p, count(*) OVER () AS n_tests
      FROM pv JOIN mm ON pv.feature = mm.feature)
SELECT *, sum(CASE WHEN p_value < 0.05 / n_tests THEN 1 ELSE 0 END) OVER () AS n_sig,
       p_value < 0.05 / n_tests AS significant FROM q
""")
def q_wilcoxon_gt_zero(spark, sf):
    long = to_long(V.w1(spark, sf), FE, ["grade", "year"])
    d = long.groupBy("feature", "year").agg(stats._pearson(F.col("value"), F.col("grade").cast("double")).alias("d"))
    return stats.wilcoxon_gt_zero(d, "feature", "d")


# ------------------------------------------------------------------ T-16..T-19
@register("bonferroni_adjust", dbl=["h", "p_value", "eta2", "p_adj"], sql=f"""
SELECT *, least(p_value * count(*) OVER (), 1e0) AS p_adj, least(p_value * count(*) OVER (), 1e0) < 0.05 AS p_adj_sig
FROM ({_KW_SQL}) kw
""")
def q_bonferroni(spark, sf):
    return stats.bonferroni_adjust(stats.kruskal_wallis(V.w1(spark, sf), FE, "grade"), "p_value")


@register("linear_trend", dbl=["slope", "intercept"], sql=f"""
SELECT area, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
       regr_count(l_extendedprice, l_quantity) AS n FROM {W1} GROUP BY area
""")
def q_linear_trend(spark, sf):
    return stats.linear_trend(V.w1(spark, sf), "l_quantity", "l_extendedprice", ["area"])


@register("ci95_mean", dbl=["mean", "std", "half_width", "lo", "hi"], sql=f"""
SELECT model, metric, condition, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n,
  1.96e0 * stddev_samp(value) / sqrt(count(value)) AS half_width,
  avg(value) - 1.96e0 * stddev_samp(value) / sqrt(count(value)) AS lo,
  avg(value) + 1.96e0 * stddev_samp(value) / sqrt(count(value)) AS hi
FROM {RS} GROUP BY model, metric, condition
""")
def q_ci95(spark, sf):
    return stats.ci95_mean(V.rs_view(spark, sf), "value", ["model", "metric", "condition"])


_MI_SQL = f"""
WITH b AS (SELECT feature, grade, least(floor((rank() OVER (PARTITION BY feature ORDER BY value) - 1) * 10
              / count(*) OVER (PARTITION BY feature)), 9) AS bin FROM {LONG} WHERE grade IS NOT NULL),
j AS (SELECT feature, bin, grade, count(*) AS nbc FROM b GROUP BY feature, bin, grade),
m AS (SELECT *, sum(nbc) OVER (PARTITION BY feature) AS nn, sum(nbc) OVER (PARTITION BY feature, bin) AS nb,
             sum(nbc) OVER (PARTITION BY feature, grade) AS nc FROM j)
SELECT feature, sum((nbc * 1e0 / nn) * ln(nbc * 1e0 * nn / (nb * nc))) AS mi FROM m GROUP BY feature
"""


@register("mutual_information", dbl=["mi"], sql=_MI_SQL)
def q_mi(spark, sf):
    return stats.mutual_information(V.w1(spark, sf), FE, "grade", bins=10)
