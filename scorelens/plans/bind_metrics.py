"""Checked bindings for metrics, score-cube aggregation and error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.operators import metrics as M
from scorelens.plans import views as V
from scorelens.plans.bind_stats import _friedman_sql
from scorelens.plans.registry import register

P = f"({V.P_SQL}) pv"
RS = f"({V.RS_SQL}) rs"
K = V.CLASSES
PROBS = {k: f"prob_{k}" for k in K}
LONG_P = " UNION ALL ".join(
    f"SELECT {k} AS cls, prob_{k} AS p, CASE WHEN label = {k} THEN 1 ELSE 0 END AS hit FROM {P}" for k in K)
VALUES_K = "(VALUES " + ", ".join(f"({k})" for k in K) + ")"


@register("confusion_matrix", dbl=["row_pct"], sql=f"""
WITH c AS (SELECT label, pred, count(*) AS c FROM {P} GROUP BY label, pred),
g AS (SELECT a.l AS label, b.l AS pred FROM {VALUES_K} a(l), {VALUES_K} b(l))
SELECT g.label, g.pred, coalesce(c.c, 0) AS count,
  coalesce(c.c, 0) * 100e0 / nullif(sum(coalesce(c.c, 0)) OVER (PARTITION BY g.label), 0) AS row_pct
FROM g LEFT JOIN c ON g.label = c.label AND g.pred = c.pred
""")
def q_confusion(spark, sf):
    return M.confusion_matrix(V.p_view(spark, sf), "label", "pred", K)


def _auc_sql(part: str, src: str) -> str:
    pb = f"PARTITION BY {part}" if part else ""
    return f"""(SELECT {part + ',' if part else ''} cast(sum(wp) AS bigint) AS n_pos, cast(sum(w) - sum(wp) AS bigint) AS n_neg,
       CASE WHEN sum(wp) > 0 AND sum(w) - sum(wp) > 0 THEN
         (sum(wp * avg_rank) - sum(wp) * (sum(wp) + 1) / 2e0) / (sum(wp) * 1e0 * (sum(w) - sum(wp))) END AS auc
     FROM (SELECT *, coalesce(sum(w) OVER ({pb} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 + (w + 1) / 2e0 AS avg_rank FROM {src}) r {'GROUP BY ' + part if part else ''})"""


_PER = f"(SELECT cls, p, count(*) AS w, sum(hit) AS wp FROM ({LONG_P}) l GROUP BY cls, p)"
_POOL = f"(SELECT p, sum(w) AS w, sum(wp) AS wp FROM {_PER} x GROUP BY p)"


@register("auroc_ovr", dbl=["auc"], sql=f"""
WITH ca AS {_auc_sql('cls', _PER)}, mi AS {_auc_sql('', _POOL)}
SELECT 'class' AS scope, cast(cls AS int) AS cls, auc, n_pos, n_neg FROM ca
UNION ALL SELECT 'macro', NULL, avg(auc), cast(sum(n_pos) AS bigint), count(auc) FROM ca
UNION ALL SELECT 'micro', NULL, auc, n_pos, n_neg FROM mi
""")
def q_auroc(spark, sf):
    return M.auroc_ovr(V.p_view(spark, sf), "label", PROBS)


# rows without the last class under each policy; "fitted" sees other names of the classes left
_PER4 = f"(SELECT cls, p, count(*) AS w, sum(hit) AS wp FROM ({LONG_P.replace(P, f'(SELECT * FROM {P} WHERE label <> {K[-1]}) p4')}) l GROUP BY cls, p)"


@register("auroc_policies", dbl=["auc"], sql=f"""
WITH ca AS {_auc_sql('cls', _PER4)},
pooled AS (SELECT p, sum(w) AS w, sum(wp) AS wp FROM {_PER4} x WHERE cls <> {K[-1]} GROUP BY p),
mi AS {_auc_sql('', 'pooled')}
SELECT 'present' AS policy, 'macro' AS scope, avg(auc) AS auc FROM ca
UNION ALL SELECT 'all', 'macro', CASE WHEN count(*) = count(auc) THEN avg(auc) END FROM ca
UNION ALL SELECT 'fitted', 'macro', avg(auc) FROM ca WHERE cls <> {K[-1]}
UNION ALL SELECT 'fitted', 'micro', auc FROM mi
""")
def q_auroc_policies(spark, sf):
    d = V.p_view(spark, sf).where(F.col("label") != K[-1])
    out = None
    for policy, labels, probs in (("present", "label", PROBS), ("all", "label", PROBS),
                                  ("fitted", "name", {k: PROBS[k] for k in K[:-1]})):
        r = M.auroc_ovr(d.withColumn("name", F.col("label") * 10), labels, probs, policy)
        r = r.where("scope = 'macro'" if policy != "fitted" else "scope <> 'class'")
        r = r.select(F.lit(policy).alias("policy"), "scope", "auc")
        out = r if out is None else out.unionByName(r)
    return out


@register("f1_accuracy", dbl=["accuracy", "macro_f1", "micro_f1", "macro_precision", "macro_recall"], sql=f"""
WITH c AS (SELECT label, pred, count(*) AS c FROM {P} WHERE label IS NOT NULL AND pred IS NOT NULL GROUP BY label, pred),
t AS (SELECT label AS k, sum(c) AS nt FROM c GROUP BY label), pp AS (SELECT pred AS k, sum(c) AS np FROM c GROUP BY pred),
tp AS (SELECT label AS k, c AS tp FROM c WHERE label = pred),
per AS (SELECT coalesce(t.k, pp.k) AS k, coalesce(nt, 0) AS nt, coalesce(np, 0) AS np FROM t FULL OUTER JOIN pp ON t.k = pp.k),
q AS (SELECT per.k, nt, np, coalesce(tp.tp, 0) AS tp FROM per LEFT JOIN tp ON per.k = tp.k),
r AS (SELECT *, coalesce(tp * 1e0 / nullif(np, 0), 0e0) AS prec, coalesce(tp * 1e0 / nullif(nt, 0), 0e0) AS rec FROM q),
f AS (SELECT *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0e0) AS f1 FROM r)
SELECT sum(tp) * 1e0 / sum(nt) AS accuracy, avg(f1) AS macro_f1, coalesce(2e0 * sum(tp) / nullif(sum(nt) + sum(np), 0), 0e0) AS micro_f1,
  avg(prec) AS macro_precision, avg(rec) AS macro_recall, cast(sum(nt) AS bigint) AS n FROM f
""")
def q_f1(spark, sf):
    return M.f1_accuracy(V.p_view(spark, sf), "label", "pred")


@register("roc_curve_macro", dbl=["fpr", "mean_tpr"], sql=f"""
WITH per AS (SELECT cls, p, sum(hit) AS tp_w, sum(1 - hit) AS fp_w FROM ({LONG_P}) l GROUP BY cls, p),
cs AS (SELECT cls, sum(tp_w) OVER (PARTITION BY cls ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
              sum(fp_w) OVER (PARTITION BY cls ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp,
              sum(tp_w) OVER (PARTITION BY cls) AS pp, sum(fp_w) OVER (PARTITION BY cls) AS nn FROM per),
pts0 AS (SELECT cls, tp, fp, pp, nn FROM cs WHERE pp > 0 AND nn > 0
         UNION ALL SELECT DISTINCT cls, 0, 0, pp, nn FROM cs WHERE pp > 0 AND nn > 0),
pts AS (SELECT *, floor(fp * 100 / nn) AS b, fp * (pp + 1) + tp AS key FROM pts0),
ext AS (SELECT cls, b, max(key) AS a, max(CASE WHEN fp * 100 = b * nn THEN key END) AS e,
               min(key) AS m, min(CASE WHEN fp * 100 <> b * nn THEN key END) AS i FROM pts GROUP BY cls, b),
gk AS (SELECT cls, pp, nn, k FROM (SELECT DISTINCT cls, pp, nn FROM pts) g, range(0, 101) r(k)),
j AS (SELECT gk.*, a, e, m, i FROM gk LEFT JOIN ext ON gk.cls = ext.cls AND gk.k = ext.b),
w AS (SELECT cls, k, pp, nn,
        greatest(e, max(a) OVER (PARTITION BY cls ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS lo,
        least(i, min(m) OVER (PARTITION BY cls ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS hi FROM j),
d AS (SELECT cls, k, pp, nn, lo // (pp + 1) AS lfp, lo % (pp + 1) AS ltp, hi // (pp + 1) AS hfp, hi % (pp + 1) AS htp, hi FROM w),
t AS (SELECT cls, k, CASE WHEN hi IS NULL OR lfp * 100 = k * nn THEN ltp / pp
        ELSE ltp / pp + (htp / pp - ltp / pp) * ((k / 100e0 - lfp / nn) / nullif(hfp / nn - lfp / nn, 0)) END AS tpr FROM d)
SELECT cast(k AS int) AS k, k / 100e0 AS fpr, avg(tpr) AS mean_tpr, count(*) AS n_classes FROM t GROUP BY k
""")
def q_roc(spark, sf):
    return M.roc_curve_macro(V.p_view(spark, sf), "label", PROBS, grid=100)


@register("aggregate_runs", dbl=["mean", "std"], sql=f"""
SELECT condition, model, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0e0) AS std, count(*) AS n_runs,
  string_agg(cast(cast(floor(value * 1e6 + 0.5e0) AS bigint) AS varchar), ',' ORDER BY seed) AS "values"
FROM {RS} WHERE value IS NOT NULL GROUP BY condition, model, metric
""")
def q_aggregate_runs(spark, sf):
    a = M.aggregate_runs(V.rs_view(spark, sf), ["condition", "model", "metric"])
    return a.withColumn("values", F.array_join(F.transform(
        "values", lambda v: F.floor(v * 1e6 + 0.5).cast("long").cast("string")), ","))


_RSR = f"({V.RS_SQL})"


@register("delta_vs_baseline", dbl=["delta_first_block", "mean_delta"], sql=f"""
WITH d AS (SELECT x.condition, x.metric, x.model, x.seed, x.value - y.value AS delta
           FROM {_RSR} x JOIN {_RSR} y ON x.condition = y.condition AND x.metric = y.metric AND x.seed = y.seed
           WHERE y.model = 'm1' AND x.model <> 'm1')
SELECT condition, metric, model, arg_min(delta, seed) AS delta_first_block, avg(delta) AS mean_delta, count(*) AS n_blocks
FROM d GROUP BY condition, metric, model
""")
def q_delta_vs_baseline(spark, sf):
    return M.delta_vs_baseline(V.rs_view(spark, sf), "m1", ["condition", "metric"])


@register("condition_delta", dbl=["mean_weighted", "mean_unweighted", "delta"], sql=f"""
SELECT model, metric, avg(CASE WHEN condition = 'weighted' THEN value END) AS mean_weighted,
  avg(CASE WHEN condition = 'unweighted' THEN value END) AS mean_unweighted,
  avg(CASE WHEN condition = 'weighted' THEN value END) - avg(CASE WHEN condition = 'unweighted' THEN value END) AS delta
FROM {RS} GROUP BY model, metric
""")
def q_condition_delta(spark, sf):
    return M.condition_delta(V.rs_view(spark, sf), ["model", "metric"], "condition", "weighted", "unweighted")


def _means(spark, sf):
    return (V.rs_view(spark, sf).where("condition = 'unweighted'").groupBy("model")
            .pivot("metric", V.RS_METRICS).agg(F.avg("value")))


_MEANS_SQL = (f"(SELECT model, avg(CASE WHEN metric = 'accuracy' THEN value END) AS accuracy, "
              f"avg(CASE WHEN metric = 'mae' THEN value END) AS mae FROM {RS} WHERE condition = 'unweighted' GROUP BY model)")


@register("rank_models", dbl=["accuracy", "mae"], sql=f"""
SELECT *, row_number() OVER (ORDER BY accuracy DESC, mae ASC, model) AS rank FROM {_MEANS_SQL} m
""")
def q_rank_models(spark, sf):
    return M.rank_models(_means(spark, sf), [("accuracy", True), ("mae", False)])


@register("training_summary", dbl=["best_value", "worst_value", "spread", "mean_std"], sql=f"""
WITH m AS (SELECT model, avg(CASE WHEN metric = 'accuracy' THEN value END) AS m,
             coalesce(stddev_samp(CASE WHEN metric = 'accuracy' THEN value END), 0e0) AS s,
             avg(CASE WHEN metric = 'mae' THEN value END) AS c FROM {RS} WHERE condition = 'unweighted' GROUP BY model)
SELECT (SELECT model FROM m ORDER BY m DESC, model DESC LIMIT 1) AS best_model, max(m) AS best_value,
  (SELECT model FROM m ORDER BY m ASC, model ASC LIMIT 1) AS worst_model, min(m) AS worst_value,
  (SELECT model FROM m ORDER BY c ASC, model ASC LIMIT 1) AS cheapest_model, max(m) - min(m) AS spread, avg(s) AS mean_std FROM m
""")
def q_training_summary(spark, sf):
    return M.training_summary(V.rs_view(spark, sf).where("condition = 'unweighted'"), "accuracy", "mae")


@register("friedman_verdict", dbl=["chi2", "p_value", "best_mean"], sql=f"""
WITH f AS ({_friedman_sql(RS, ['condition', 'metric'], 'seed', 'model', 'value')}),
m AS (SELECT condition, metric, model, avg(value) AS mean_value FROM {RS} GROUP BY condition, metric, model),
b AS (SELECT *, row_number() OVER (PARTITION BY condition, metric
        ORDER BY CASE WHEN metric = 'mae' THEN -mean_value ELSE mean_value END DESC, model) AS rn FROM m)
SELECT f.condition, f.metric, chi2, p_value, p_value < 0.05 AS significant, b.model AS best_model, b.mean_value AS best_mean
FROM f JOIN b ON f.condition = b.condition AND f.metric = b.metric AND b.rn = 1
""")
def q_friedman_verdict(spark, sf):
    return M.friedman_verdict(V.rs_view(spark, sf), ["condition", "metric"], "seed", "model", "value",
                              higher_is_better={"accuracy": True, "mae": False})


@register("error_rate_by_group", dbl=["error_rate"], sql=" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{g}' AS group_col, cast({g} AS varchar) AS level, count(*) AS n, "
    f"cast(sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS bigint) AS hits, "
    f"1 - sum(CASE WHEN label = pred THEN 1 ELSE 0 END) * 1e0 / count(*) AS error_rate FROM {P} GROUP BY {g}) x{i}"
    for i, g in enumerate(["label", "product", "area"])).join(
    ["SELECT *, row_number() OVER (PARTITION BY group_col ORDER BY error_rate DESC, level) = 1 AS is_worst FROM (", ") u"]))
def q_error_rate(spark, sf):
    return M.error_rate_by_group(V.p_view(spark, sf), "label", "pred", ["label", "product", "area"])


@register("hard_cases", dbl=["confidence"], sql=f"""
SELECT row_key, label, pred, abs(label - pred) AS gap, greatest({', '.join(PROBS.values())}) AS confidence
FROM {P} WHERE label <> pred ORDER BY gap DESC, confidence DESC, row_key LIMIT 10
""")
def q_hard_cases(spark, sf):
    return M.hard_cases(V.p_view(spark, sf), "label", "pred", list(PROBS.values()), "row_key", 10)
