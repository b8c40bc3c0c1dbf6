"""The comparison queries fit all five models."""

import pytest

from scorelens.operators import models as MD
from scorelens.plans import bind_models as BM

from conftest import SF_SMALL


def test_boosting_has_the_rounds_and_step_of_the_reference():
    s = MD.build_estimator(BM.SPECS["gbt"], "features", "label_index", None, 100.0, 1).settings
    assert (s.rounds, s.step, s.leaves) == (300, 0.05, 31)


def test_real_fits_at_small_settings(spark):
    """All models, fitted, over two seeds and two conditions; nothing replaced."""
    small = {"forest": {"n_trees": 3, "max_depth": 3}, "gbt": {"rounds": 3}, "logistic": {"max_iter": 5}, "tree": {"max_depth": 3}}
    specs = [MD.ModelSpec(k, params=small.get(k, {})) for k in BM.SPECS]
    out = MD.run_repeated(specs, BM.data(spark, SF_SMALL, BM.DIMS[:8]), [42, 142], conditions={"unweighted": None, "weighted": "w"},
                          split=BM.split, prepare=BM.weigh).collect()
    assert len(out) == 5 * 2 * 2 * 6 and all(r["value"] is not None for r in out)
    assert all(0 <= r["value"] <= 1 for r in out if r["metric"] != "fit_seconds")


@pytest.mark.parametrize("query, runs", [(BM.q_run_repeated, 10), (BM.q_strategy_benchmark, 3), (BM.q_ablation, 1)])
def test_every_model_is_compared(spark, monkeypatch, query, runs):
    monkeypatch.setattr(MD, "fit_boosted", lambda *a, **k: dict.fromkeys(range(99)))
    monkeypatch.setattr(MD, "evaluate_model", lambda *a, **k: ({"accuracy": 0.5}, None))
    got = {r["model"]: r["count"] for r in query(spark, SF_SMALL).groupBy("model").count().collect()}
    assert got == {kind: runs for kind in ("logistic", "tree", "forest", "gbt", "ordinal")}
