"""Checked bindings for §2.8 (importance tables, linear attribution summaries)."""

from __future__ import annotations

from math import factorial

from pyspark.sql import functions as F

from scorelens.operators import explain as X
from scorelens.operators import paths as PT
from scorelens.operators import stats
from scorelens.plans import views as V
from scorelens.plans.helpers import checkpoint
from scorelens.plans.bind_stats import _IMP_SQL, _KW_SQL, _MI_SQL, _avg_rank_sql, _imp, _r
from scorelens.plans.registry import register

W1 = f"({V.W1_SQL}) w1"
W2 = f"({V.W2_SQL}) w2"
FE = V.FEATURES
AF = V.FEATURES                                      # attribution inputs of the aggregated queries


def _coef(features):
    return {k: {f: round((k - 2) * (i + 1) / 10.0, 6) for i, f in enumerate(features)} for k in V.CLASSES}


BG_YEAR = 1995                                       # background rows for the attribution baseline
DIMS = [f"e{i}" for i in range(V.EMB_DIM)]


def _attr(spark, sf, features=AF):
    w = V.w1(spark, sf)
    return X.linear_attribution(w.select("row_key", *features), _coef(features), features, "row_key",
                                background=w.where(F.col("year") == BG_YEAR))


def _attr_sql(features):
    coef = "(VALUES " + ", ".join(f"({k}, '{f}', {w!r}e0)" for k, fw in _coef(features).items() for f, w in fw.items()) + \
        ") ct(cls, feature, coef)"
    return f"""(SELECT l.row_key, cast(ct.cls AS int) AS cls, l.feature, ct.coef * (l.x - mu.mu) AS phi, l.x
FROM (UNPIVOT (SELECT row_key, {', '.join(f'cast({f} AS double) AS {f}' for f in features)} FROM {W1})
      ON {', '.join(features)} INTO NAME feature VALUE x) l
JOIN ({' UNION ALL '.join(f"SELECT '{f}' AS feature, avg(cast({f} AS double)) AS mu FROM {W1} WHERE year = {BG_YEAR}" for f in features)}) mu
  ON l.feature = mu.feature
JOIN {coef} ON l.feature = ct.feature)"""


ATTR_SQL = _attr_sql(AF)


# a given tree: node -> (column, threshold, left, right, rows) or (rows, values by class)
TREE_COLUMNS = ["l_quantity", "p_size", "l_linenumber"]
TREE = {0: ("l_quantity", 24.5, 1, 2, 100.0), 1: ("p_size", 20.5, 3, 4, 60.0), 2: ("l_linenumber", 3.5, 5, 6, 40.0),
        4: ("l_quantity", 10.5, 7, 8, 35.0), 3: (25.0, [0.5, 0.25, 0.25]), 5: (24.0, [0.125, 0.75, 0.125]),
        6: (16.0, [0.25, 0.25, 0.5]), 7: (14.0, [0.0, 0.5, 0.5]), 8: (21.0, [1.0, 0.0, 0.0])}


def _given_value(node: int, known: tuple, cls: int) -> str:
    """SQL of the tree's expectation when only ``known`` columns are given."""
    if len(TREE[node]) == 2:
        return f"{TREE[node][1][cls]!r}e0"
    col, thr, left, right, rows = TREE[node]
    a, b = (_given_value(x, known, cls) for x in (left, right))
    if col in known:
        return f"(CASE WHEN {col} <= {thr} THEN {a} ELSE {b} END)"
    share = [TREE[x][-1 if len(TREE[x]) == 5 else 0] / rows for x in (left, right)]
    return f"({share[0]!r}e0 * {a} + {share[1]!r}e0 * {b})"


def _shapley_sql(col: str, cls: int) -> str:
    """SQL of a column's Shapley value: all orders of the other columns."""
    others = [c for c in TREE_COLUMNS if c != col]
    terms = []
    for mask in range(2 ** len(others)):
        known = tuple(c for i, c in enumerate(others) if mask >> i & 1)
        weight = factorial(len(known)) * factorial(len(others) - len(known)) / factorial(len(TREE_COLUMNS))
        terms.append(f"{weight!r}e0 * ({_given_value(0, known + (col,), cls)} - {_given_value(0, known, cls)})")
    return " + ".join(terms)


@register("tree_attribution_given", dbl=["phi", "x", "base_value"], sql=" UNION ALL ".join(
    f"SELECT row_key, {c} AS cls, '{f}' AS feature, {_shapley_sql(f, c)} AS phi, cast({f} AS double) AS x, {_given_value(0, (), c)} AS base_value FROM {W1}"
    for f in TREE_COLUMNS for c in range(3)))
def q_tree_attribution_given(spark, sf):
    """I-10 with a given node table: path attribution equals the Shapley values by definition."""
    rows = [(0, n, TREE_COLUMNS.index(t[0]), t[1], t[2], t[3], t[4], []) if len(t) == 5 else (0, n, -1, None, -1, -1, t[0], t[1])
            for n, t in TREE.items()]
    nodes = spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, cover double, value array<double>")
    return PT.path_attribution(PT.leaf_paths(nodes), V.w1(spark, sf), TREE_COLUMNS, "row_key")


_SUMMARY = f"""(SELECT feature, avg(abs(phi)) AS mean_abs_phi, avg(phi) AS mean_phi FROM {ATTR_SQL} a GROUP BY feature)"""


@register("attribution_summary", dbl=["mean_abs_phi", "mean_phi"], sql=f"""
SELECT *, CASE WHEN mean_phi > 0 THEN 'positive' WHEN mean_phi < 0 THEN 'negative' ELSE 'neutral' END AS direction
FROM {_SUMMARY} s
""")
def q_attr_summary(spark, sf):
    return X.attribution_summary(_attr(spark, sf))


@register("attribution_class_matrix", dbl=["mean_phi"], sql=f"""
WITH t AS (SELECT feature FROM {_SUMMARY} s ORDER BY mean_abs_phi DESC, feature LIMIT 12)
SELECT cls, feature, avg(phi) AS mean_phi FROM {ATTR_SQL} a WHERE feature IN (SELECT feature FROM t) GROUP BY cls, feature
""")
def q_attr_matrix(spark, sf):
    return X.attribution_class_matrix(_attr(spark, sf), 12)


@register("attribution_direction", dbl=["mean_abs_phi", "mean_phi"], sql=f"""
WITH s AS (SELECT feature, avg(abs(phi)) AS mean_abs_phi, avg(phi) AS mean_phi FROM {ATTR_SQL} a WHERE cls = 5 GROUP BY feature),
p AS (SELECT quantile_cont(mean_abs_phi, 0.75) AS p75 FROM s WHERE mean_abs_phi > 0),
r AS (SELECT s.*, CASE WHEN mean_abs_phi < coalesce(p75, 0) * 0.05 THEN 'weak' WHEN mean_phi > 0 THEN 'raises'
        WHEN mean_phi < 0 THEN 'lowers' ELSE 'weak' END AS label,
        row_number() OVER (ORDER BY mean_abs_phi DESC, feature) AS rank FROM s, p)
SELECT * FROM r WHERE rank <= 35
""")
def q_attr_direction(spark, sf):
    return X.attribution_direction(_attr(spark, sf), 5)


@register("attribution_dependence", dbl=["slope", "intercept"], sql=f"""
SELECT cls, regr_slope(phi, x) AS slope, regr_intercept(phi, x) AS intercept, regr_count(phi, x) AS n
FROM {ATTR_SQL} a WHERE feature = 'l_quantity' GROUP BY cls
""")
def q_attr_dependence(spark, sf):
    return X.attribution_dependence(_attr(spark, sf), "l_quantity")


# Queries with a row per row and feature. The background means come from exact decimal
# sums in both engines, running totals and class sums from ordered lists in the SQL. The
# names with ``_all`` go over the long table, the others stay inside the row.
def _background(spark, sf):
    return V.w1(spark, sf).where(F.col("year") == BG_YEAR).select(*[F.col(f).cast("decimal(18,2)").alias(f) for f in AF])


def _attr_all(spark, sf, keep=None):
    return X.linear_attribution(V.w1(spark, sf), _coef(AF), AF, "row_key", background=_background(spark, sf), keep=keep)


def _rows(spark, sf, keep=None):
    return X.attribution_rows(V.w1(spark, sf), _coef(AF), AF, "row_key", background=_background(spark, sf), keep=keep)


ALL_SQL = f"""(SELECT l.row_key, cast(ct.cls AS int) AS cls, l.feature, ct.coef * (l.x - mu.mu) AS phi, l.x
FROM (UNPIVOT (SELECT row_key, {', '.join(f'cast({f} AS double) AS {f}' for f in AF)} FROM {W1})
      ON {', '.join(AF)} INTO NAME feature VALUE x) l
JOIN ({' UNION ALL '.join(f"SELECT '{f}' AS feature, cast(sum(cast({f} AS decimal(18,2))) AS double) / count({f}) AS mu "
                          f"FROM {W1} WHERE year = {BG_YEAR}" for f in AF)}) mu
  ON l.feature = mu.feature
JOIN (VALUES {', '.join(f"({k}, '{f}', {c!r}e0)" for k, fw in _coef(AF).items() for f, c in fw.items())}) ct(cls, feature, coef)
  ON l.feature = ct.feature)"""


@register("linear_attribution", dbl=["phi", "x"], sql=f"SELECT * FROM {ALL_SQL} a")
def q_linear_attribution(spark, sf):
    names = F.array(*[F.lit(f) for f in AF])
    cells = _rows(spark, sf).select("row_key", "x", F.explode("phi").alias("cls", "p"))
    return cells.select("row_key", "cls", F.inline(F.arrays_zip(names.alias("feature"), F.col("p").alias("phi"), F.col("x"))))


@register("linear_attribution_all", dbl=["phi", "x"], sql=f"SELECT * FROM {ALL_SQL} a")
def q_linear_attribution_all(spark, sf):
    return _attr_all(spark, sf)


_WATERFALL_SQL = f"""
WITH a AS (SELECT a.* FROM {ALL_SQL} a JOIN (SELECT row_key, grade FROM {W1}) g ON a.row_key = g.row_key AND a.cls = g.grade),
r AS (SELECT row_key, cls, list(struct_pack(feature := feature, phi := phi) ORDER BY abs(phi) DESC, feature)[:10] AS l
      FROM a GROUP BY row_key, cls),
s AS (SELECT row_key, cls, l, unnest(range(1, len(l) + 1)) AS step FROM r)
SELECT row_key, cls, l[step].feature AS feature, l[step].phi AS phi, step,
  list_reduce(list_prepend(0e0, list_transform(l[1:step], lambda e: e.phi)), lambda p, q: p + q) AS cum_phi
FROM s
"""


@register("attribution_waterfall", dbl=["phi", "cum_phi"], sql=_WATERFALL_SQL)
def q_attr_waterfall(spark, sf):
    return X.waterfall_rows(_rows(spark, sf, ["grade"]), AF, "grade", "row_key", 10)


@register("attribution_waterfall_all", dbl=["phi", "cum_phi"], sql=_WATERFALL_SQL)
def q_attr_waterfall_all(spark, sf):
    return X.attribution_waterfall(_attr_all(spark, sf, ["grade"]), "row_key", 10, cls_of_row="grade")


_POINTS_SQL = f"""
WITH s AS (SELECT row_key, feature, list_reduce(list_prepend(0e0, list(phi ORDER BY cls)), lambda p, q: p + q) AS phi_sum, any_value(x) AS x
           FROM {ALL_SQL} a GROUP BY row_key, feature),
t AS (SELECT feature FROM s GROUP BY feature ORDER BY avg(abs(phi_sum)) DESC, feature LIMIT 15),
s2 AS (SELECT * FROM s WHERE feature IN (SELECT feature FROM t)),
mm AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM s2 GROUP BY feature)
SELECT row_key, s2.feature, phi_sum, (x - lo) / (hi - lo + 1e-12) AS x_scaled FROM s2 JOIN mm ON s2.feature = mm.feature
"""


@register("attribution_points", dbl=["phi_sum", "x_scaled"], sql=_POINTS_SQL)
def q_attr_points(spark, sf):
    return X.points_rows(_rows(spark, sf), AF, "row_key", 15)


@register("attribution_points_all", dbl=["phi_sum", "x_scaled"], sql=_POINTS_SQL)
def q_attr_points_all(spark, sf):
    return X.attribution_points(_attr_all(spark, sf), "row_key", 15)


@register("class_contrast", dbl=["mean_phi_low", "mean_phi_high"], sql=f"""
SELECT feature, avg(CASE WHEN cls = 1 THEN phi END) AS mean_phi_low, avg(CASE WHEN cls = 5 THEN phi END) AS mean_phi_high,
  cast(sum(CASE WHEN cls = 1 AND phi > 0 THEN 1 ELSE 0 END) AS bigint) AS n_pos_low,
  cast(sum(CASE WHEN cls = 1 AND phi < 0 THEN 1 ELSE 0 END) AS bigint) AS n_neg_low,
  cast(sum(CASE WHEN cls = 5 AND phi > 0 THEN 1 ELSE 0 END) AS bigint) AS n_pos_high,
  cast(sum(CASE WHEN cls = 5 AND phi < 0 THEN 1 ELSE 0 END) AS bigint) AS n_neg_high
FROM {ATTR_SQL} a WHERE cls IN (1, 5) GROUP BY feature
""")
def q_class_contrast(spark, sf):
    return X.class_contrast(_attr(spark, sf), 1, 5)


# -------------------------------------------------------------- importance
@register("consensus_importance", dbl=["consensus", "share_pct"], sql=f"""
WITH imp AS (SELECT feature, client AS model, avg(imp) AS value FROM {_IMP_SQL} i GROUP BY feature, client),
n AS (SELECT feature, model, value / (sum(value) OVER (PARTITION BY model) + 1e-12) AS share FROM imp),
c AS (SELECT feature, avg(share) AS consensus, count(*) AS n_models FROM n GROUP BY feature),
r AS (SELECT feature, consensus, consensus * 100 AS share_pct, n_models, row_number() OVER (ORDER BY consensus DESC, feature) AS rank FROM c)
SELECT * FROM r WHERE rank <= 30
""")
def q_consensus(spark, sf):
    imp = _imp(spark, sf).groupBy("feature", F.col("client").alias("model")).agg(F.avg("imp").alias("value"))
    return X.consensus_importance(imp)


_SPEAR_SQL = (f"(SELECT feature, abs(covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0)) AS abs_rho FROM "
              f"(SELECT feature, {_avg_rank_sql('feature', 'value')} AS rx, {_avg_rank_sql('feature', 'grade')} AS ry "
              f"FROM (UNPIVOT (SELECT grade, {', '.join(FE)} FROM {W1}) ON {', '.join(FE)} INTO NAME feature VALUE value) u) r GROUP BY feature)")
_ABSR_SQL = "(" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs({_r(c, 'grade')}) AS abs_r FROM {W1}" for c in FE) + ")"
_SCORES_SQL = f"""(SELECT a.feature, a.abs_r, s.abs_rho, m.mi, k.eta2 FROM {_ABSR_SQL} a
  JOIN {_SPEAR_SQL} s ON a.feature = s.feature JOIN ({_MI_SQL}) m ON a.feature = m.feature
  JOIN ({_KW_SQL}) k ON a.feature = k.feature)"""
_SC = ["abs_r", "abs_rho", "mi", "eta2"]
_ENS_SQL = f"""(SELECT feature, {', '.join(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-12) AS n_{c}' for c in _SC)}
  FROM {_SCORES_SQL} sc)"""
_ENS2_SQL = f"""(SELECT *, ({' + '.join(f'n_{c}' for c in _SC)}) / {len(_SC)}e0 AS ensemble_score FROM {_ENS_SQL} e)"""


def _scores(spark, sf):
    """(four scores per feature, the Kruskal-Wallis table among them in full)."""
    w = V.w1(spark, sf)
    a = stats.corr_with_target(w, FE, "grade").select("feature", "abs_r")
    ranked = stats.feature_ranks(w, FE, "grade")
    s = stats.spearman_with_target(w, FE, "grade", ranked).select("feature", F.abs("rho").alias("abs_rho"))
    m = stats.mutual_information(w, FE, "grade", ranked=ranked)
    k = checkpoint(stats.kruskal_wallis(w, FE, "grade", ranked=ranked))        # one row per feature
    return a.join(s, "feature").join(m, "feature").join(k.select("feature", "eta2"), "feature"), k


@register("ensemble_rank", dbl=[f"n_{c}" for c in _SC] + ["ensemble_score"], sql=f"""
SELECT *, row_number() OVER (ORDER BY ensemble_score DESC, feature) AS rank FROM {_ENS2_SQL} e2
""")
def q_ensemble(spark, sf):
    return X.ensemble_rank(_scores(spark, sf)[0], _SC)


@register("importance_vs_separation", dbl=["ensemble_score", "eta2", "rho"], sql=f"""
WITH j AS (SELECT e.feature, e.ensemble_score, k.eta2 FROM {_ENS2_SQL} e JOIN ({_KW_SQL}) k ON e.feature = k.feature),
r AS (SELECT {_avg_rank_sql('1', 'ensemble_score')} AS ra, {_avg_rank_sql('1', 'eta2')} AS rb FROM j
      WHERE ensemble_score IS NOT NULL AND eta2 IS NOT NULL),
s AS (SELECT covar_samp(ra, rb) / nullif(stddev_samp(ra) * stddev_samp(rb), 0) AS rho, count(*) AS n FROM r)
SELECT j.*, s.rho, s.n FROM j, s
""")
def q_importance_vs_separation(spark, sf):
    scores, kw = _scores(spark, sf)
    return X.importance_vs_separation(X.ensemble_rank(scores, _SC), kw)


_W2_ABS_R = (f"(SELECT feature, abs(covar_samp(value, label) / nullif(stddev_samp(value) * stddev_samp(label), 0)) AS score "
             f"FROM (UNPIVOT (SELECT label, {', '.join(DIMS)} FROM {W2}) ON {', '.join(DIMS)} "
             f"INTO NAME feature VALUE value) u GROUP BY feature)")


def _w2_scores(spark, sf):
    return stats.corr_with_target(V.w2(spark, sf), DIMS, "label").select("feature", F.col("abs_r").alias("score"))


@register("top_bottom_groups", dbl=["score"], sql=f"""
WITH r AS (SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature) AS rank, count(*) OVER () AS n FROM {_W2_ABS_R} s)
SELECT feature, score, rank, CASE WHEN rank <= 20 THEN 'top' WHEN rank > n - 15 THEN 'bottom' ELSE 'middle' END AS grp FROM r
""")
def q_top_bottom(spark, sf):
    return X.top_bottom_groups(_w2_scores(spark, sf), "score", 20, 15)


_W2_LONG = f"(SELECT * FROM (SELECT {', '.join(DIMS)} FROM {W2}) t UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(DIMS)})))"


@register("important_vs_rest_profile", dbl=["m1", "m2", "t_stat", "dof"], sql=f"""
WITH top AS (SELECT feature FROM {_W2_ABS_R} s ORDER BY score DESC, feature LIMIT 10),
s AS (SELECT feature, count(*) AS n_all, count(value) AS n, avg(value) AS mu, stddev_samp(value) AS sd,
             skewness(value) AS sk, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {_W2_LONG} l GROUP BY feature),
b AS (SELECT *, CASE WHEN q3 > q1 THEN q3 - q1 ELSE sd + 1e-9 END AS iqr FROM s),
f AS (SELECT *, q1 - 1.5 * iqr AS lo, q3 + 1.5 * iqr AS hi FROM b),
o AS (SELECT l.feature, sum(CASE WHEN value < lo OR value > hi THEN 1 ELSE 0 END) AS n_out
      FROM {_W2_LONG} l JOIN f ON l.feature = f.feature WHERE value IS NOT NULL GROUP BY l.feature),
shp AS (SELECT f.feature, (n_all - n) * 1e0 / n_all AS missing_rate,
  CASE WHEN n >= 5 THEN (sd + 1e-9) / (abs(mu) + 1e-6) END AS cv, CASE WHEN n >= 5 THEN iqr END AS iqr,
  CASE WHEN n >= 5 THEN n_out * 1e0 / n END AS outlier_rate, CASE WHEN n >= 5 THEN sk END AS skew
  FROM f LEFT JOIN o ON f.feature = o.feature),
lg AS (SELECT stat, value, CASE WHEN feature IN (SELECT feature FROM top) THEN 'top' ELSE 'rest' END AS grp
       FROM (UNPIVOT shp ON missing_rate, cv, iqr, outlier_rate, skew INTO NAME stat VALUE value) u),
w AS (SELECT stat, avg(CASE WHEN grp = 'top' THEN value END) AS m1, avg(CASE WHEN grp <> 'top' THEN value END) AS m2,
  var_samp(CASE WHEN grp = 'top' THEN value END) AS v1, var_samp(CASE WHEN grp <> 'top' THEN value END) AS v2,
  count(CASE WHEN grp = 'top' THEN value END) AS n1, count(CASE WHEN grp <> 'top' THEN value END) AS n2 FROM lg GROUP BY stat)
SELECT stat, n1, n2, m1, m2, (m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0) AS t_stat,
  (v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / nullif((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1), 0) AS dof
FROM w
""")
def q_important_vs_rest(spark, sf):
    top = [r["feature"] for r in _w2_scores(spark, sf).orderBy(F.col("score").desc(), "feature").limit(10).collect()]
    return X.important_vs_rest_profile(V.w2(spark, sf), DIMS, top)
