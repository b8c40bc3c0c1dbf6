"""Random forests: splits by brute force, draws that hang on the seed alone, bounded tasks."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from scorelens.operators import forest as FO
from scorelens.operators import models as MD

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=3)), float(rng.integers(0, 3))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double").selectExpr(
        "*", "cast(CASE WHEN a + 0.3 * c < -0.5 THEN 0 WHEN d = 1 THEN 1 ELSE 2 END AS double) AS label_index", "1 + id % 3 AS w")
    return MD.assemble(df, COLS).cache()


def predicted(model, df):
    return {r["id"]: (r["p"], r["prediction"]) for r in model.transform(df).select("id", vector_to_array("probability").alias("p"), "prediction").collect()}


def test_splits_are_the_best_of_the_tried_features():
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(0, 8, (300, 5)).astype(np.uint8), rng.integers(0, 3, 300), rng.random(300) + 0.1
    node = np.sort(rng.integers(0, 6, 300))
    total = np.stack([np.bincount(y[node == i], w[node == i], 3) for i in range(6)])
    tried = np.sort(np.stack([rng.permutation(5)[:3] for _ in range(6)]), axis=1)
    gain, feature, cut = FO._best(x, np.arange(300), y, w, node, total, tried, 8)
    score = lambda t: (t ** 2).sum() / t.sum()
    for i in range(6):
        own, best = node == i, 0.0
        for f in tried[i]:
            for b in range(7):
                left = own & (x[:, f] <= b)
                if left.any() and (own & ~left).any():
                    l = np.bincount(y[left], w[left], 3)
                    best = max(best, score(l) + score(total[i] - l) - score(total[i]))
        left = own & (x[:, feature[i]] <= cut[i])
        l = np.bincount(y[left], w[left], 3)
        assert gain[i] == pytest.approx(best) == pytest.approx(score(l) + score(total[i] - l) - score(total[i]))
        assert feature[i] in tried[i]


def test_cells_taken_in_parts_give_the_same_tree(monkeypatch):
    rng = np.random.default_rng(1)
    x, y, w = rng.integers(0, 32, (500, 6)).astype(np.uint8), rng.integers(0, 4, 500), np.ones(500)
    a = FO.grow(x, y, w, 4, FO.Forest(10, 12), 3)
    monkeypatch.setattr(FO, "CELLS", 64)
    b = FO.grow(x, y, w, 4, FO.Forest(10, 12), 3)
    assert all(np.array_equal(getattr(a, c), getattr(b, c)) for c in FO.Tree.KINDS)
    # every leaf's share and cover are those of the drawn rows
    assert a.cover[0] == np.random.default_rng([42, 3]).poisson(1.0, 500).sum()
    inner = np.flatnonzero(a.left >= 0)
    assert np.array_equal(a.cover[inner], a.cover[a.left[inner]] + a.cover[a.left[inner] + 1])
    # no two leaves of one class side by side
    best = a.dist.argmax(1)
    both = inner[(a.left[a.left[inner]] < 0) & (a.left[a.left[inner] + 1] < 0)]
    assert (best[-1 - a.left[a.left[both]]] != best[-1 - a.left[a.left[both] + 1]]).all()


def test_importances_of_noise_are_spread_as_in_the_library(spark):
    rng = np.random.default_rng(5)
    cols = [f"c{i}" for i in range(16)]
    rows = [(float(rng.integers(0, 8)), *map(float, rng.normal(size=16))) for _ in range(200)]
    df = MD.assemble(spark.createDataFrame(rows, ["label_index", *cols]), cols).cache()
    own = MD.train_random_forest(n_trees=100, max_depth=12).fit(df).featureImportances.toArray()
    theirs = RandomForestClassifier(featuresCol="features", labelCol="label_index", numTrees=100, maxDepth=12, seed=42).fit(df).featureImportances.toArray()
    # many splits of small nodes are equally good: which feature is tried first shows
    assert np.allclose(own, theirs, atol=0.02) and abs(own[:8].sum() - theirs[:8].sum()) < 0.03


def test_partitions_do_not_change_the_forest(spark, table):
    est = MD.train_random_forest(n_trees=7, max_depth=5, seed=1)
    a, b = (predicted(est.fit(table.repartition(n, F.xxhash64("id", F.lit(n)))), table) for n in (1, 5))
    assert a == b
    assert predicted(MD.train_random_forest(n_trees=7, max_depth=5, seed=2).fit(table), table) != a


def test_trees_stay_a_table_and_large_forests_meet_the_rows_in_groups(spark, table, monkeypatch):
    model = MD.train_random_forest(n_trees=9, max_depth=6, weight="w").fit(table)
    assert model.table.count() == model.trees == 9 and model.featureImportances.toArray().sum() == pytest.approx(1)
    small = predicted(model, table)
    monkeypatch.setattr(FO, "SEND_BYTES", model.bytes // 4)
    monkeypatch.setattr(FO, "BLOCK_ROWS", 100)
    large = predicted(model, table)
    assert small.keys() == large.keys()
    for i in small:
        assert np.allclose(small[i][0], large[i][0], atol=1e-12) and sum(large[i][0]) == pytest.approx(1)
    assert sum(small[i][1] == large[i][1] for i in small) >= 599


def test_learns_as_well_as_the_library(spark, table):
    tr, te = table.where("id % 3 > 0"), table.where("id % 3 = 0")
    share = lambda m: m.transform(te).agg(F.avg((F.col("prediction") == F.col("label_index")).cast("double"))).first()[0]
    own = MD.train_random_forest(n_trees=60, max_depth=10).fit(tr)
    theirs = RandomForestClassifier(featuresCol="features", labelCol="label_index", numTrees=60, maxDepth=10, seed=42).fit(tr)
    assert share(own) > share(theirs) - 0.04
    assert np.allclose(own.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.06)


def test_more_rows_than_a_task_takes_go_to_the_library(spark, table):
    m = FO.fit_forest(table, FO.Forest(3, 4), part_bytes=1000)
    assert not isinstance(m, FO.ForestModel) and m.getNumTrees == 3


@pytest.mark.parametrize("bad", ["NULL AS label_index", "-1D AS label_index", "0.5D AS label_index", "-1D AS w", "double('NaN') AS w",
                                 "double('NaN') AS a", "double('inf') AS a", "CAST(NULL AS double) AS a"])
def test_what_the_library_refuses_is_refused(spark, bad):
    whole = spark.range(20).selectExpr("cast(id AS double) AS a", "cast(id % 2 AS double) AS label_index", "1D AS w")
    name = bad.split()[-1]
    df = whole.selectExpr(*[f"CASE WHEN a < 1 THEN {bad[:-len(name) - 4]} ELSE {name} END AS {name}" if c == name else c for c in whole.columns])
    MD.train_random_forest(n_trees=2, weight="w").fit(MD.assemble(whole, ["a"]))
    with pytest.raises(ValueError):
        MD.train_random_forest(n_trees=2, weight="w").fit(MD.assemble(df, ["a"]))
