"""Known-answer and invariant tests on hand-made micro tables."""

import numpy as np
import pandas as pd
import pytest

from scorelens.operators import derive, metrics, prep, profile, stats
from scorelens.plans.rank import collapse, distributed_rank


def test_friedman_full_order_gives_published_chi2(spark):
    # 4 models x 5 seeds, the same full order in every seed -> chi^2 = 15.0 exactly
    rows = [(s, m, float(10 * m + s)) for s in range(5) for m in range(4)]
    df = spark.createDataFrame(rows, "seed int, model int, value double")
    r = stats.friedman_test(df, "seed", "model", "value").collect()[0]
    assert r["chi2"] == pytest.approx(15.0)
    assert r["p_value"] == pytest.approx(0.0018166, abs=1e-6)


def test_friedman_needs_three(spark):
    df = spark.createDataFrame([(s, m, float(m)) for s in range(2) for m in range(3)], "seed int, model int, value double")
    r = stats.friedman_test(df, "seed", "model", "value").collect()[0]
    assert r["chi2"] is None and r["note"]


def test_wilcoxon_pairs_all_positive_and_all_zero(spark):
    rows = [(s, "a", 1.0 + s) for s in range(5)] + [(s, "b", 0.5 + s * 0.9) for s in range(5)] + \
           [(s, "c", 1.0 + s) for s in range(5)]
    df = spark.createDataFrame(rows, "seed int, model string, value double")
    res = {(r["a"], r["b"]): r for r in stats.wilcoxon_pairs(df, "seed", "model", "value").collect()}
    ab = res[("a", "b")]                     # a - b > 0 in all five seeds
    assert ab["w"] == 0 and ab["p_value"] == pytest.approx(0.0625)
    assert ab["p_adj"] == pytest.approx(min(1.0, 0.0625 * 3))
    ac = res[("a", "c")]                     # all differences zero
    assert ac["w"] == 0 and ac["p_value"] == 1.0


def test_wilcoxon_gt_zero_constant_positive_forced_zero(spark):
    rows = [("f1", 0.2)] * 5 + [("f2", 0.0)] * 5 + [("f3", v) for v in (0.1, 0.3, 0.2, 0.5, 0.4)]
    df = spark.createDataFrame(rows, "feature string, v double")
    r = {x["feature"]: x for x in stats.wilcoxon_gt_zero(df, "feature", "v").collect()}
    assert r["f1"]["p_value"] == 0.0
    assert r["f2"]["p_value"] == 1.0
    assert r["f3"]["p_value"] == pytest.approx(1 / 32)
    assert r["f3"]["min_attainable_p"] == pytest.approx(1 / 32)


def _kw_reference(values, groups):
    d = pd.DataFrame({"v": values, "g": groups})
    d["r"] = d["v"].rank(method="average")
    n = len(d)
    h = 12 / (n * (n + 1)) * sum(g["r"].sum() ** 2 / len(g) for _, g in d.groupby("g")) - 3 * (n + 1)
    t = d["v"].value_counts().to_numpy(dtype=float)
    return h / (1 - (t ** 3 - t).sum() / (n ** 3 - n))


def test_kruskal_wallis_tie_correction(spark):
    vals = [1, 2, 2, 3, 5, 2, 3, 3, 4, 6, 1, 1, 2, 5, 5]
    grp = [1] * 5 + [2] * 5 + [3] * 5
    df = spark.createDataFrame([(float(v), g) for v, g in zip(vals, grp)], "x double, g int")
    r = stats.kruskal_wallis(df, ["x"], "g").collect()[0]
    assert r["h"] == pytest.approx(_kw_reference(vals, grp), rel=1e-12)
    assert r["k"] == 3
    assert r["eta2"] == pytest.approx(max((r["h"] - 3 + 1) / (15 - 3), 0.0))


def test_kruskal_drops_small_groups_and_single_group(spark):
    rows = [(float(i), 1) for i in range(6)] + [(10.0, 2), (11.0, 2)]
    df = spark.createDataFrame(rows, "x double, g int")
    r = stats.kruskal_wallis(df, ["x"], "g").collect()[0]
    assert r["k"] == 1 and r["h"] is None


def test_skew_and_std_known_answer(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 4.0, 7.5)], "x double")
    s = profile.column_shape_stats(df, ["x"]).collect()[0]
    assert s["skew"] == pytest.approx(1.3904, abs=1e-4)
    p = profile.profile_columns(df, ["x"]).collect()[0]
    assert p["std"] == pytest.approx(2.5884, abs=1e-4)
    z = prep.standard_scale(df, ["x"]).collect()
    pop = np.std([1, 2, 2, 4, 7.5])
    assert z[0]["x"] == pytest.approx((1 - 3.3) / pop)
    assert pop == pytest.approx(2.3152, abs=1e-4)


def test_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(6)], "c double, y double")
    assert stats.corr_with_target(df, ["c"], "y").collect()[0]["r"] is None
    assert stats.linear_trend(df, "c", "y").collect()[0]["slope"] is None
    assert derive.zscore_columns(df, ["c"]).collect()[0]["c"] == 1.0
    one = spark.createDataFrame([(1.0,)], "x double")
    assert profile.profile_columns(one, ["x"]).collect()[0]["std"] is None


def test_distributed_rank_matches_pandas_with_hot_value(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([np.full(400, 3.0), rng.integers(0, 50, 800).astype(float)])  # one value = 1/3 of rows
    g = rng.integers(0, 3, len(v))
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(pdf)
    r = distributed_rank(collapse(df, ["g"], "v"), ["g"], "v").toPandas()
    exp = pdf.assign(rk=pdf.groupby("g")["v"].rank(method="average")).drop_duplicates(["g", "v"])
    m = exp.merge(r, on=["g", "v"])
    assert len(m) == len(exp)
    assert np.allclose(m["rk"], m["avg_rank"])


def test_distributed_rank_plan_has_no_single_partition(spark):
    df = spark.range(1000).selectExpr("id % 7 AS g", "cast(id % 97 AS double) AS v")
    r = distributed_rank(collapse(df, ["g"], "v"), ["g"], "v")
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in plan


def test_average_rank_rows(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([5, 1, 3, 3, 9])], "id int, x double")
    r = {row["id"]: row["rank"] for row in stats.average_rank(df, "x").collect()}
    assert r == {0: 4.0, 1: 1.0, 2: 2.5, 3: 2.5, 4: 5.0}


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, 300).astype(float)
    y = (x + rng.integers(0, 10, 300)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    rho = stats.spearman_with_target(df, ["x"], "y").collect()[0]["rho"]
    rx = pd.Series(x).rank(method="average")
    ry = pd.Series(y.astype(float)).rank(method="average")
    assert rho == pytest.approx(rx.corr(ry), rel=1e-10)


def test_mann_whitney_u_value(spark):
    a = [1.0, 4.0, 2.0, 8.0, 6.0]
    b = [3.0, 5.0, 7.0, 9.0, 10.0, 11.0]
    df = spark.createDataFrame([(x, "a") for x in a] + [(x, "b") for x in b], "v double, g string")
    r = stats.mann_whitney_u(df, "v", "g", "a").collect()[0]
    u = sum(1.0 for x in a for y in b if x > y) + 0.5 * sum(1.0 for x in a for y in b if x == y)
    assert r["u"] == pytest.approx(u)


def test_kendall_w_perfect_agreement(spark):
    rows = [(r, o, float(o)) for r in range(4) for o in range(6)]
    df = spark.createDataFrame(rows, "rater int, obj int, v double")
    w = stats.kendall_w(df, "rater", "obj", "v").collect()[0]
    assert w["w"] == pytest.approx(1.0, rel=1e-9)


def test_mutual_information_ranks_signal_first(spark):
    rng = np.random.default_rng(2)
    c = rng.integers(0, 3, 2000)
    pdf = pd.DataFrame({"c": c, "sig": c * 2.0 + rng.normal(0, 0.5, 2000), "noise": rng.normal(0, 1, 2000)})
    mi = stats.mutual_information(spark.createDataFrame(pdf), ["sig", "noise"], "c").collect()
    assert mi[0]["feature"] == "sig" and mi[0]["mi"] > 5 * mi[1]["mi"]


def test_domain_prefix_longest_match(spark):
    df = spark.createDataFrame([(n,) for n in ["t1", "t1_x", "t10_x", "c_x", "cost"]], "name string")
    m = {"t1": "T1", "t10": "T10", "c": "C"}
    r = {x["name"]: x["domain"] for x in derive.domain_prefix_tag(df, "name", m).collect()}
    assert r == {"t1": "T1", "t1_x": "T1", "t10_x": "T10", "c_x": "C", "cost": "other"}
    lab = {x["name"]: x["label"] for x in derive.feature_label(df, "name", m).collect()}
    assert lab["t10_x"] == "[T10] x" and lab["t1"] == "[T1] t1"


def _brute_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def test_auroc_matches_brute_force_and_flip(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 300)
    p = rng.dirichlet([1, 1, 1], 300).round(2)            # ties on purpose
    pdf = pd.DataFrame({"y": y, "p0": p[:, 0], "p1": p[:, 1], "p2": p[:, 2]})
    df = spark.createDataFrame(pdf)
    res = {(r["scope"], r["cls"]): r["auc"] for r in metrics.auroc_ovr(df, "y", {0: "p0", 1: "p1", 2: "p2"}).collect()}
    for k in range(3):
        assert res[("class", k)] == pytest.approx(_brute_auc((y == k).astype(int), p[:, k]))
    flipped = df.select("y", *[(1 - df[c]).alias(c) for c in ("p0", "p1", "p2")])
    res2 = {(r["scope"], r["cls"]): r["auc"] for r in metrics.auroc_ovr(flipped, "y", {0: "p0", 1: "p1", 2: "p2"}).collect()}
    assert res2[("class", 0)] == pytest.approx(1 - res[("class", 0)])


def test_roc_macro_matches_numpy_interp(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 400)
    p = rng.dirichlet([2, 2, 2], 400).round(3)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p0": p[:, 0], "p1": p[:, 1], "p2": p[:, 2]}))
    got = metrics.roc_curve_macro(df, "y", {0: "p0", 1: "p1", 2: "p2"}).orderBy("k").toPandas()
    grid = np.linspace(0, 1, 101)
    curves = []
    for k in range(3):
        s, t = p[:, k], (y == k).astype(int)
        thr = np.unique(s)[::-1]
        tpr = [0.0] + [((s >= th) & (t == 1)).sum() / t.sum() for th in thr]
        fpr = [0.0] + [((s >= th) & (t == 0)).sum() / (1 - t).sum() for th in thr]
        curves.append(np.interp(grid, fpr, tpr))
    assert np.allclose(got["mean_tpr"].to_numpy(), np.mean(curves, axis=0), atol=1e-9)


def test_confusion_and_f1(spark):
    rows = [(1, 1), (1, 2), (2, 2), (2, 2), (3, 1)]
    df = spark.createDataFrame(rows, "y int, p int")
    cm = {(r["y"], r["p"]): r["count"] for r in metrics.confusion_matrix(df, "y", "p", [1, 2, 3]).collect()}
    assert cm[(3, 3)] == 0 and cm[(2, 2)] == 2 and len(cm) == 9
    f = metrics.f1_accuracy(df, "y", "p").collect()[0]
    assert f["accuracy"] == pytest.approx(0.6)
    # per class F1: 1 -> 0.5, 2 -> 0.8, 3 -> 0
    assert f["macro_f1"] == pytest.approx((0.5 + 0.8 + 0.0) / 3)
    assert f["micro_f1"] == pytest.approx(0.6)


def test_splits_are_exact(spark):
    df = spark.range(1003).selectExpr("cast(id AS string) AS k", "cast(id % 4 AS int) AS c")
    s = prep.split_random(df, ["k"], 0.2, 7)
    assert s.where("split = 'test'").count() == int(np.ceil(1003 * 0.2))
    st = prep.split_stratified(df, ["k"], "c", 0.2, 7)
    assert st.where("split = 'test'").count() == int(np.ceil(1003 * 0.2))
    per = {r["c"]: r["n"] for r in st.where("split = 'test'").groupBy("c").count().withColumnRenamed("count", "n").collect()}
    assert all(abs(per[c] - 0.2 * 1003 / 4) < 1.01 for c in per)
    tm = prep.split_time(df.withColumn("t", df.k.cast("int")), "t", ["k"], 0.25)
    assert tm.where("split = 'train'").agg({"t": "max"}).collect()[0][0] == int(1003 * 0.75) - 1


def test_exact_quantiles_match_numpy(spark):
    from scorelens.plans.rank import exact_quantiles
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "v": rng.integers(0, 40, 500).astype(float)})
    q = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", [0.1, 0.25, 0.5, 0.9]).toPandas()
    for r in q.itertuples():
        exp = np.quantile(pdf.loc[pdf.g == r.g, "v"].to_numpy(), r.p)
        assert r.q == pytest.approx(exp, rel=1e-12)


def test_masked_gram_with_nulls_equals_pandas(spark):
    """64 columns, holes of every kind, a constant column, columns far from zero."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 64)) @ rng.normal(size=(64, 64)) + np.linspace(0, 1e6, 64)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5] = 3.25
    x[3:, 9] = np.nan                                   # pairs with few or no common rows
    x[:, 11] = np.nan
    cols = [f"c{i}" for i in range(64)]
    pdf = pd.DataFrame(x, columns=cols)
    df = spark.createDataFrame([[None if np.isnan(v) and i % 2 else float(v) for i, v in enumerate(r)] for r in x],
                               ", ".join(f"{c} double" for c in cols))
    got = {(r["var1"], r["var2"]): r["r"] for r in stats.pearson_matrix(df.repartition(5), cols).collect()}
    want = pdf.corr(min_periods=2)
    assert len(got) == 64 * 64
    for a in cols:
        for b in cols:
            w, g = want.loc[a, b], got[a, b]
            if a == b:
                assert g == 1.0
            elif np.isnan(w):
                assert g is None, (a, b, g)
            else:
                assert g == pytest.approx(w, rel=1e-7, abs=1e-9)


def test_masked_gram_of_empty_table(spark):
    got = stats.pearson_matrix(spark.createDataFrame([], "a double, b double"), ["a", "b"]).collect()
    assert [r["r"] for r in got if r["var1"] != r["var2"]] in ([], [None, None])


def test_rank_statistics_of_one_plan(spark):
    """Ties, a hot value, a small class, nulls: against scipy-like formulas in pandas."""
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({"g": rng.integers(0, 4, n), "a": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 30, n)),
                        "b": rng.normal(size=n)})
    pdf.loc[:1, "g"] = 9                                # a class of two rows
    pdf.loc[pdf.index % 7 == 0, "b"] = np.nan
    df = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r)
                                for r in pdf.itertuples(index=False)], "g long, a double, b double")
    kw = {r["feature"]: r for r in stats.kruskal_wallis(df, ["a", "b"], "g").collect()}
    sp = {r["feature"]: r for r in stats.spearman_with_target(df, ["a", "b"], "g").collect()}
    for f in ("a", "b"):
        d = pdf[["g", f]].dropna()
        assert sp[f]["rho"] == pytest.approx(d["g"].rank().corr(d[f].rank()), abs=1e-12) and sp[f]["n"] == len(d)
        d = d[d["g"].map(d["g"].value_counts()) >= 3]
        r, m = d[f].rank(), len(d)
        h = 12 / (m * (m + 1)) * sum(r[d["g"] == k].sum() ** 2 / (d["g"] == k).sum() for k in d["g"].unique()) - 3 * (m + 1)
        t = d[f].value_counts()
        h /= 1 - (t ** 3 - t).sum() / (m ** 3 - m)
        assert kw[f]["h"] == pytest.approx(h, rel=1e-10) and kw[f]["n"] == m and kw[f]["k"] == d["g"].nunique()


def test_auroc_with_classes_fitted_on_the_labels(spark):
    df = spark.createDataFrame([("lo", 0.9, 0.1), ("hi", 0.8, 0.2), ("lo", 0.3, 0.7), (None, 0.1, 0.9), ("hi", 0.4, 0.6)],
                               "y string, p0 double, p1 double")
    res = {(r["scope"], r["cls"]): r["auc"] for r in
           metrics.auroc_ovr(df, "y", {0: "p0", 1: "p1"}, "fitted").collect()}
    # classes in order: hi takes p0, lo takes p1
    assert res[("class", "hi")] == pytest.approx(_brute_auc(np.array([0, 1, 0, 1]), np.array([0.9, 0.8, 0.3, 0.4])))
    assert res[("class", "lo")] == pytest.approx(_brute_auc(np.array([1, 0, 1, 0]), np.array([0.1, 0.2, 0.7, 0.6])))
    with pytest.raises(ValueError):
        metrics.auroc_ovr(df, "y", {0: "p0"}, "fitted")
    with pytest.raises(ValueError):
        metrics.auroc_ovr(df.where("y = 'lo'"), "y", {0: "p0", 1: "p1"}, "fitted")
