"""Classification metrics, run aggregation and error analysis
(SURVEY §2.7 M-06 … M-09, M-12 … M-15, M-18, M-19; §2.8 E-01, E-02).

AUROC is computed from ranks (Mann-Whitney form) with the distributed rank,
so neither sorting nor the per-class score table is ever held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.operators import stats
from scorelens.plans.helpers import checkpoint
from scorelens.plans.rank import distributed_cumsum, distributed_rank

def _wall():
    """One window over a small, already aggregated table (built lazily: modules
    are imported on executors, where no session exists)."""
    return Window.partitionBy(F.lit(1))


def _long_probs(df: DataFrame, label: str, prob_cols: dict) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(k).alias("cls"), F.col(c).cast("double").alias("p")) for k, c in prob_cols.items()])
    return (df.where(F.col(label).isNotNull()).select(F.col(label).alias("__y"), F.inline(arr))
              .select("cls", "p", (F.col("__y") == F.col("cls")).cast("int").alias("hit")))


def confusion_matrix(df: DataFrame, label: str, pred: str, labels: list) -> DataFrame:
    """M-06: counts on the full label grid, with row-normalised percentages."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], f"{label} int, {pred} int")
    c = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("count"))
    g = F.broadcast(grid).join(c, [label, pred], "left").fillna(0, ["count"])   # grid is labels^2 rows
    tot = F.sum("count").over(Window.partitionBy(label))
    return g.select(label, pred, "count", F.try_divide(F.col("count") * 100.0, tot.cast("double")).alias("row_pct"))


def _auc(ranked: DataFrame, keys: list[str]) -> DataFrame:
    g = ranked.groupBy(*keys) if keys else ranked.groupBy()
    s = g.agg(F.sum(F.col("wp") * F.col("avg_rank")).alias("rpos"), F.sum("wp").alias("n_pos"),
              (F.sum("w") - F.sum("wp")).alias("n_neg"))
    npos, nneg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    auc = F.try_divide(F.col("rpos") - npos * (npos + 1) / 2, npos * nneg)
    return s.select(*keys, F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
                    F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), auc).alias("auc"))


def auroc_ovr(df: DataFrame, label: str, prob_cols: dict, policy: str = "present") -> DataFrame:
    """M-07: one-vs-rest AUROC per class, macro and micro.

    ``policy='present'`` averages over classes that have positives (absent
    classes drop out); ``'all'`` makes the macro NULL when a class has none; ``'fitted'``
    takes the classes from the labels of these rows, in their order, for the probability
    columns in theirs (the labels' own names need not be the columns'), and raises
    ValueError when there are not as many of one as of the other."""
    if policy not in ("present", "all", "fitted"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "fitted":
        found = [r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct()
                                 .limit(len(prob_cols) + 1).collect()]      # one more than fits is enough to know
        if len(found) != len(prob_cols):
            raise ValueError(f"the labels' classes do not match {len(prob_cols)} probability columns")
        prob_cols = dict(zip(sorted(found), prob_cols.values()))
    kind = "int" if all(isinstance(k, int) for k in prob_cols) else "string"       # of the classes' names
    long = _long_probs(df, label, prob_cols)
    # collapsed (class, score) counts feed both the per-class and the pooled
    # ranking: materialised once so the rows are read a single time
    per = checkpoint(long.groupBy("cls", "p").agg(F.count(F.lit(1)).alias("w"), F.sum("hit").alias("wp")))
    rk = distributed_rank(per, ["cls"], "p")
    cls_auc = _auc(rk, ["cls"])
    pooled = per.groupBy("p").agg(F.sum("w").alias("w"), F.sum("wp").alias("wp"))
    micro = _auc(distributed_rank(pooled, [], "p"), [])
    if policy == "all":
        macro_v = F.when(F.count(F.lit(1)) == F.count("auc"), F.avg("auc"))
    else:
        macro_v = F.avg("auc")
    macro = cls_auc.agg(macro_v.alias("auc"), F.sum("n_pos").alias("n_pos"), F.count("auc").alias("n_neg"))
    return (cls_auc.select(F.lit("class").alias("scope"), F.col("cls").cast(kind).alias("cls"), "auc", "n_pos", "n_neg")
            .unionByName(macro.select(F.lit("macro").alias("scope"), F.lit(None).cast(kind).alias("cls"), "auc",
                                      F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg")))
            .unionByName(micro.select(F.lit("micro").alias("scope"), F.lit(None).cast(kind).alias("cls"), "auc",
                                      "n_pos", "n_neg")))


def f1_accuracy(df: DataFrame, label: str, pred: str, labels: list | None = None) -> DataFrame:
    """M-08: accuracy, macro / micro F1, macro precision and recall (0 on 0/0).

    Labels: the given list ('all' policy) or the union of true and predicted
    labels present in the data (sklearn default)."""
    # one lineage: every (true, pred) count is emitted once as a "true" row and
    # once as a "predicted" row, then a single groupBy(label) gives tp / nt / np
    c = df.where(F.col(label).isNotNull() & F.col(pred).isNotNull()).groupBy(label, pred).agg(
        F.count(F.lit(1)).alias("c"))
    z = F.lit(0).cast("long")
    both = F.array(
        F.struct(F.col(label).alias("k"), F.col("c").alias("nt"), z.alias("np"),
                 F.when(F.col(label) == F.col(pred), F.col("c")).otherwise(z).alias("tp")),
        F.struct(F.col(pred).alias("k"), z.alias("nt"), F.col("c").alias("np"), z.alias("tp")))
    per = c.select(F.inline(both)).groupBy("k").agg(F.sum("nt").alias("nt"), F.sum("np").alias("np"),
                                                    F.sum("tp").alias("tp"))
    if labels is not None:
        ks = df.sparkSession.createDataFrame([(x,) for x in labels], "k int")
        per = F.broadcast(ks).join(per, "k", "left").fillna(0, ["tp", "nt", "np"])   # labels list: a parameter
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("np").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("nt").cast("double")), F.lit(0.0))
    per = per.select("k", "tp", "nt", "np", prec.alias("prec"), rec.alias("rec"))
    f1 = F.coalesce(F.try_divide(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")), F.lit(0.0))
    per = per.withColumn("f1", f1)
    return per.agg(
        (F.sum("tp") / F.sum("nt")).alias("accuracy"), F.avg("f1").alias("macro_f1"),
        F.coalesce(F.try_divide(2 * F.sum("tp").cast("double"), (F.sum("nt") + F.sum("np")).cast("double")),
                   F.lit(0.0)).alias("micro_f1"),
        F.avg("prec").alias("macro_precision"), F.avg("rec").alias("macro_recall"),
        F.sum("nt").cast("long").alias("n"))


def roc_curve_macro(df: DataFrame, label: str, prob_cols: dict, grid: int = 100) -> DataFrame:
    """M-09: per-class ROC, linearly interpolated on ``grid + 1`` FPR points and
    averaged over the classes that have positives and negatives.

    Points come from distributed running sums over distinct scores (descending).
    Each point is reduced to its FPR bin ``floor(grid * FP / N)``; for every
    (class, bin) only the first and last points are kept, so everything after
    the running sums holds at most classes x (grid + 1) x 2 rows."""
    long = _long_probs(df, label, prob_cols)
    per = long.groupBy("cls", "p").agg(F.sum("hit").alias("tp_w"), F.sum(1 - F.col("hit")).alias("fp_w"))
    cs = distributed_cumsum(per, ["cls"], [-F.col("p")], ["tp_w", "fp_w"])
    pts = cs.select("cls", (F.col("before_tp_w") + F.col("tp_w")).alias("tp"),
                    (F.col("before_fp_w") + F.col("fp_w")).alias("fp"),
                    F.col("total_tp_w").alias("P"), F.col("total_fp_w").alias("N"))
    pts = pts.where((F.col("P") > 0) & (F.col("N") > 0))
    origin = pts.select("cls", "P", "N").distinct().select("cls", F.lit(0).cast("long").alias("tp"),
                                                            F.lit(0).cast("long").alias("fp"), "P", "N")
    pts = pts.select("cls", F.col("tp").cast("long"), F.col("fp").cast("long"), "P", "N").unionByName(origin)
    pts = pts.withColumn("b", F.floor(F.col("fp") * grid / F.col("N")).cast("int"))
    # Grid point k needs L_k = max (fp, tp) with fp*grid <= k*N and U_k = min (fp, tp)
    # with fp*grid > k*N. Per (class, bin b): A = all points' max, E = max of points
    # exactly on the left edge (fp*grid = b*N), M = all points' min, I = min of the
    # points strictly inside. Then L_k = greatest(E_k, max_{b<k} A_b) and
    # U_k = least(I_k, min_{b>k} M_b): running max / min over <= grid + 1 bins.
    st = F.struct("fp", "tp")
    edge = F.col("fp") * grid == F.col("b") * F.col("N")
    ext = pts.groupBy("cls", "b").agg(
        F.max(st).alias("A"), F.max(F.when(edge, st)).alias("E"),
        F.min(st).alias("M"), F.min(F.when(~edge, st)).alias("I"))
    g = (pts.select("cls", "P", "N").distinct()
            .select("cls", "P", "N", F.explode(F.sequence(F.lit(0), F.lit(grid))).alias("k")))
    ext = ext.withColumnRenamed("cls", "__ecls")
    j = (g.join(ext, (F.col("cls") == F.col("__ecls")) & (F.col("k") == F.col("b")), "left")   # one bin per grid point
          .drop("__ecls"))
    wk = Window.partitionBy("cls").orderBy("k")
    prev_a = F.max("A").over(wk.rowsBetween(Window.unboundedPreceding, -1))
    next_m = F.min("M").over(wk.rowsBetween(1, Window.unboundedFollowing))
    agg = j.select("cls", "k", "P", "N", F.greatest(F.col("E"), prev_a).alias("lo"),
                   F.least(F.col("I"), next_m).alias("hi"))
    x = F.col("k") / float(grid)
    lfpr = F.col("lo.fp") / F.col("N")
    ltpr = F.col("lo.tp") / F.col("P")
    hfpr = F.col("hi.fp") / F.col("N")
    htpr = F.col("hi.tp") / F.col("P")
    on_point = F.col("lo.fp") * grid == F.col("k") * F.col("N")
    tpr = F.when(F.col("hi").isNull() | on_point, ltpr).otherwise(
        ltpr + (htpr - ltpr) * F.try_divide(x - lfpr, hfpr - lfpr))
    per_cls = agg.select("cls", "k", tpr.alias("tpr"))
    return (per_cls.groupBy("k").agg(F.avg("tpr").alias("mean_tpr"), F.count(F.lit(1)).alias("n_classes"))
                   .select(F.col("k").cast("int").alias("k"), (F.col("k") / float(grid)).alias("fpr"), "mean_tpr",
                           "n_classes"))


# --------------------------------------------------------------- score cubes
def aggregate_runs(scores: DataFrame, keys: list[str], value: str = "value", order: str = "seed") -> DataFrame:
    """M-12: mean, sample std (0 for one run), count and the ordered value list;
    NULL values are skipped."""
    s = scores.where(F.col(value).isNotNull())
    vals = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))),
                       lambda x: x["v"])
    return s.groupBy(*keys).agg(F.avg(value).alias("mean"),
                                F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
                                F.count(F.lit(1)).alias("n_runs"), vals.alias("values"))


def delta_vs_baseline(scores: DataFrame, baseline: str, keys: list[str], model: str = "model",
                      block: str = "seed", value: str = "value") -> DataFrame:
    """M-13: metric minus baseline per block (first block and mean over blocks)."""
    base = scores.where(F.col(model) == baseline).select(*keys, block, F.col(value).alias("__b"))
    d = (scores.where(F.col(model) != baseline).join(base, [*keys, block])
               .select(*keys, model, block, (F.col(value) - F.col("__b")).alias("delta")))
    return d.groupBy(*keys, model).agg(
        F.min_by("delta", block).alias("delta_first_block"), F.avg("delta").alias("mean_delta"),
        F.count(F.lit(1)).alias("n_blocks"))


def condition_delta(scores: DataFrame, keys: list[str], cond: str, a: str, b: str, value: str = "value") -> DataFrame:
    """M-14: mean(value | cond = a) - mean(value | cond = b) per key."""
    return scores.groupBy(*keys).agg(
        F.avg(F.when(F.col(cond) == a, F.col(value))).alias(f"mean_{a}"),
        F.avg(F.when(F.col(cond) == b, F.col(value))).alias(f"mean_{b}")).withColumn(
        "delta", F.col(f"mean_{a}") - F.col(f"mean_{b}"))


def rank_models(means: DataFrame, order: list[tuple[str, bool]], model: str = "model") -> DataFrame:
    """M-15: row_number over the given (column, descending) sort, model name as tie-break."""
    w = _wall().orderBy(*[F.col(c).desc() if d else F.col(c).asc() for c, d in order], F.col(model))
    return means.withColumn("rank", F.row_number().over(w).cast("long"))


def training_summary(scores: DataFrame, metric: str, cost_metric: str, model: str = "model",
                     value: str = "value", metric_col: str = "metric") -> DataFrame:
    """M-18: best / worst model by the mean of ``metric``, cheapest by
    ``cost_metric``, top - bottom spread and the mean per-model std."""
    m = scores.where(F.col(metric_col).isin(metric, cost_metric)).groupBy(model).agg(
        F.avg(F.when(F.col(metric_col) == metric, F.col(value))).alias("m"),
        F.coalesce(F.stddev_samp(F.when(F.col(metric_col) == metric, F.col(value))), F.lit(0.0)).alias("s"),
        F.avg(F.when(F.col(metric_col) == cost_metric, F.col(value))).alias("c"))
    return m.agg(
        F.max(F.struct(F.col("m"), F.col(model))).alias("best"),
        F.min(F.struct(F.col("m"), F.col(model))).alias("worst"),
        F.min(F.struct(F.col("c"), F.col(model))).alias("cheapest"),
        F.avg("s").alias("mean_std")).select(
        F.col(f"best.{model}").alias("best_model"), F.col("best.m").alias("best_value"),
        F.col(f"worst.{model}").alias("worst_model"), F.col("worst.m").alias("worst_value"),
        F.col(f"cheapest.{model}").alias("cheapest_model"),
        (F.col("best.m") - F.col("worst.m")).alias("spread"), "mean_std")


def friedman_verdict(scores: DataFrame, by: list[str], block: str, model: str, value: str,
                     higher_is_better: dict | None = None, alpha: float = 0.05,
                     metric_col: str = "metric") -> DataFrame:
    """M-19: per group: Friedman significant? and the best model by mean."""
    f = stats.friedman_test(scores, block, model, value, by=by)
    m = scores.groupBy(*by, model).agg(F.avg(value).alias("mean_value"))
    hib = higher_is_better or {}
    sign = F.lit(1.0)
    for k, v in hib.items():
        sign = F.when(F.col(metric_col) == k, F.lit(1.0 if v else -1.0)).otherwise(sign)
    w = Window.partitionBy(*by).orderBy((F.col("mean_value") * sign).desc(), F.col(model))
    best = m.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        *by, F.col(model).alias("best_model"), F.col("mean_value").alias("best_mean"))
    return f.join(best, by).select(*by, "chi2", "p_value", (F.col("p_value") < alpha).alias("significant"),
                                   "best_model", "best_mean")


# ------------------------------------------------------------- error analysis
def error_rate_by_group(df: DataFrame, label: str, pred: str, groups: list[str]) -> DataFrame:
    """E-01: count, hits and error rate per level of every group column (one
    scan with grouping sets) and the worst level of each column."""
    hit = F.when(F.col(label) == F.col(pred), 1).otherwise(0)
    d = df.select(*[F.col(g).cast("string").alias(g) for g in groups], hit.alias("__hit"))
    g = d.groupingSets([[F.col(c)] for c in groups], *groups).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__hit").alias("hits"), *[F.grouping(c).alias(f"__g_{c}") for c in groups])
    name = None
    level = None
    for c in groups:
        cond = F.col(f"__g_{c}") == 0
        name = F.when(cond, F.lit(c)) if name is None else name.when(cond, F.lit(c))
        level = F.when(cond, F.col(c)) if level is None else level.when(cond, F.col(c))
    r = g.select(name.alias("group_col"), level.alias("level"), "n", F.col("hits").cast("long").alias("hits"),
                 (1 - F.col("hits") / F.col("n")).alias("error_rate"))
    w = Window.partitionBy("group_col").orderBy(F.col("error_rate").desc(), F.col("level"))
    return r.withColumn("is_worst", F.row_number().over(w) == 1)


def hard_cases(df: DataFrame, label: str, pred: str, prob_cols: list[str], key: str, k: int = 10) -> DataFrame:
    """E-02: wrong rows by |true - pred| desc, confidence desc, key asc; top k."""
    conf = F.greatest(*[F.col(c) for c in prob_cols])
    w = df.where(F.col(label) != F.col(pred)).select(key, label, pred, F.abs(F.col(label) - F.col(pred)).alias("gap"),
                                                     conf.alias("confidence"))
    return w.orderBy(F.col("gap").desc(), F.col("confidence").desc(), F.col(key)).limit(k)
