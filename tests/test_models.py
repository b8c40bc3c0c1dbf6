"""Training, PCA and attribution: schema, ranges, determinism, planted signal."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scorelens.operators import importance as I
from scorelens.operators import models as MD
from scorelens.operators import paths as PT
from scorelens.operators import prep
from scorelens.plans import bind_models as BM
from scorelens.plans.bind_sources import SURVEY_CLASS_PROBS
from scorelens.sources import synth


DOMAIN_TOTALS = [f"{d}_{k}_total" for d in synth.DOMAINS for k in synth.KINDS]


def split(df, seed=42):
    d = prep.split_stratified(df, ["id"], "rpi", 0.2, seed)
    return d.where("split = 'train'"), d.where("split = 'test'")


@pytest.fixture(scope="module")
def survey(spark):
    """A table with a planted class signal."""
    s = synth.synth_survey_latent(spark.range(1500).withColumnRenamed("id", "k"), "k", SURVEY_CLASS_PROBS)
    return MD.assemble(s.withColumn("label_index", (F.col("rpi") - 1).cast("double")), DOMAIN_TOTALS).cache()


def test_planted_signal_is_learned(spark, survey):
    tr, te = split(survey)
    res, _ = MD.evaluate_model(BM.SPECS["logistic"], tr, te, n_classes=5)
    assert res["macro_auroc"] > 0.85
    assert 0 <= res["accuracy"] <= 1


def test_same_seed_same_result(spark, survey):
    tr, te = split(survey)
    a, _ = MD.evaluate_model(BM.SPECS["tree"], tr, te, n_classes=5, seed=3)
    b, _ = MD.evaluate_model(BM.SPECS["tree"], tr, te, n_classes=5, seed=3)
    assert a["macro_f1"] == b["macro_f1"]


def test_ordinal_probabilities_sum_to_one(spark, survey):
    tr, te = split(survey)
    m = MD.OrdinalLogistic().fit(tr)
    p = m.transform(te).select(vector_to_array("probability").alias("p")).toPandas()
    s = np.array([sum(x) for x in p["p"]])
    assert np.allclose(s, 1.0, atol=1e-9)


def test_pca_scree_cumulative(spark, survey):
    sc = MD.pca_scree(survey).orderBy("component").toPandas()
    assert sc["cumulative"].iloc[-1] == pytest.approx(1.0, abs=1e-9)
    assert (np.diff(sc["share"]) <= 1e-12).all()


def test_tree_shap_local_accuracy(spark, survey):
    tr, te = split(survey)
    te = te.limit(40)
    for model in (MD.train_decision_tree(max_depth=4).fit(tr),
                  MD.train_random_forest(n_trees=3, max_depth=3).fit(tr)):
        attr = PT.tree_attribution(model, te, DOMAIN_TOTALS, "id")
        s = attr.groupBy("id", "cls").agg((F.sum("phi") + F.first("base_value")).alias("f")).toPandas()
        pred = model.transform(te).select("id", vector_to_array("probability").alias("p")).toPandas()
        pm = {(r.id, c): r.p[c] for r in pred.itertuples() for c in range(5)}
        for r in s.itertuples():
            assert r.f == pytest.approx(pm[(r.id, r.cls)], abs=1e-9)


def test_permutation_importance_finds_informative_feature(spark, survey):
    d = survey.drop("features")
    tr, te = split(d)
    model = BM._lr_pipeline(DOMAIN_TOTALS).fit(tr)
    imp = I.permutation_importance(model, te, DOMAIN_TOTALS, "label_index", "id", repeats=2).toPandas()
    assert len(imp) == len(DOMAIN_TOTALS)
    # every total carries the planted class signal: permuting them must cost score
    assert imp["mean_drop"].max() > 0.01
    assert (imp["n_repeats"] == 2).all()


def test_ordinal_thresholds_share_one_slope_and_learn(spark, survey):
    tr, te = split(survey)
    res, m = MD.evaluate_model(BM.SPECS["ordinal"], tr, te, n_classes=5)
    assert res["macro_auroc"] > 0.8
    assert len(m.slope) == len(DOMAIN_TOTALS) and m.cuts == sorted(m.cuts, reverse=True) and len(m.cuts) == 4


@pytest.mark.parametrize("kind", ["ordinal", "gbt"])
def test_weights_change_boosted_and_ordinal_models(spark, survey, kind):
    tr, te = split(survey)
    tr = tr.withColumn("w", F.when(F.col("rpi") == 1, 50.0).otherwise(1.0))
    spec = MD.ModelSpec(kind, params={"rounds": 3, "depth": 2} if kind == "gbt" else {})
    share = []
    for w in (None, "w"):
        est = MD.build_estimator(spec, "features", "label_index", w, float(tr.count()), 1)
        p = MD.with_class_probs(est.fit(tr).transform(te), 5)
        share.append(p.agg(F.avg("prob_0")).first()[0])
    assert share[1] > share[0] + 0.05


def test_permutation_importance_by_auroc(spark, survey):
    tr, te = split(survey.drop("features"))
    model = BM._lr_pipeline(DOMAIN_TOTALS).fit(tr)
    pdf = I.permutation_importance(model, te, DOMAIN_TOTALS, "label_index", "id", repeats=1, scorer="macro_auroc").toPandas()
    assert 0.5 < pdf["baseline"].iloc[0] <= 1 and pdf["mean_drop"].max() > 0


def test_batch_score_gives_every_class_without_labels(spark, survey, tmp_path):
    tr, te = split(survey.drop("features"))
    model = MD.load_pipeline(MD.save_pipeline(BM._lr_pipeline(DOMAIN_TOTALS).fit(tr), str(tmp_path / "m")))
    out = I.batch_score(model, te, keep=["id"])
    assert [c for c in out.columns if c.startswith("prob_")] == [f"prob_{k}" for k in range(5)]
    assert out.selectExpr("abs(prob_0 + prob_1 + prob_2 + prob_3 + prob_4 - 1) < 1e-9 AS ok").distinct().collect() == [(True,)]


def test_preprocess_exact_median_population_scale_unknown_level(spark):
    tr = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "a"), (10.0, None)], "x double, c string")
    model = prep.preprocess_pipeline(["x"], ["c"]).fit(tr)
    assert model.names == ["num__x", "cat__c_a", "cat__c_b"]
    x = np.array([1.0, 2.0, 2.0, 10.0])
    te = spark.createDataFrame([(2.0, "zzz"), (None, "b")], "x double, c string")
    got = [r[0] for r in model.transform(te).select(vector_to_array("features")).collect()]
    z = (2.0 - x.mean()) / x.std()
    assert np.allclose(got, [[z, 0, 0], [z, 0, 1]])


def test_pca_variance_fits_once_and_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    df = MD.assemble(spark.createDataFrame([tuple(map(float, r)) for r in a], [f"c{i}" for i in range(5)]), [f"c{i}" for i in range(5)])
    k, res, _ = MD.pca_variance(df, 0.9)
    share = np.linalg.eigvalsh(np.corrcoef(a.T))[::-1]
    share = np.cumsum(share / share.sum())
    assert k == int(np.searchsorted(share, 0.9) + 1)
    assert len(res.select(vector_to_array("pca")).first()[0]) == k
