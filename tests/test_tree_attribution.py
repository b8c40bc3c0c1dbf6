"""Path attribution (I-10) against Shapley values by definition, over all feature subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from scorelens.operators import boosting as B
from scorelens.operators import models as MD
from scorelens.operators import paths as PT

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (300, 4)).astype(float)
    y = (x[:, 0] > 4).astype(int) + (x[:, 1] * x[:, 2] > 20)
    rows = [(int(i), float(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x))]
    return MD.assemble(spark.createDataFrame(rows, ["id", "label_index", *COLS]), COLS).cache()


def by_definition(nodes, x, k):
    """phi [features, classes] and the base value of one tree's node rows."""
    at = {r["node"]: r for r in nodes}

    def value(n, known):
        r = at[n]
        if r["left"] < 0:
            return np.array(r["value"])
        if r["feature"] in known:
            return value(r["left"] if x[r["feature"]] <= r["threshold"] else r["right"], known)
        return sum(at[c]["cover"] / r["cover"] * value(c, known) for c in (r["left"], r["right"]))

    p = len(x)
    phi = np.zeros((p, k))
    for i in range(p):
        rest = [j for j in range(p) if j != i]
        for size in range(p):
            for s in combinations(rest, size):
                weight = factorial(size) * factorial(p - size - 1) / factorial(p)
                phi[i] += weight * (value(0, {*s, i}) - value(0, set(s)))
    return phi, value(0, set())


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted"])
def test_equals_shapley_values_over_all_subsets(spark, table, kind):
    model = {"tree": lambda: MD.train_decision_tree(max_depth=4).fit(table),
             "forest": lambda: MD.train_random_forest(n_trees=3, max_depth=4).fit(table),
             "boosted": lambda: B.fit_boosted(table, 3, B.Boosting(rounds=2, step=0.3, depth=4, min_rows=5))[0]}[kind]()
    rows = table.where("id % 60 = 7").collect()
    got = {}
    for r in PT.tree_attribution(model, table.where("id % 60 = 7"), COLS, "id").collect():
        got[r["id"], r["feature"], r["cls"]] = r["phi"], r["base_value"], r["x"]
    assert len(got) == len(rows) * 4 * 3
    trees = {}
    for r in PT.node_table(model, spark).collect():
        trees.setdefault(r["tree"], []).append(r)
    share = 1.0 if kind == "boosted" else 1 / len(trees)
    for row in rows:
        x = [row[c] for c in COLS]
        each = [by_definition(n, x, 3) for n in trees.values()]
        phi, base = sum(e[0] for e in each) * share, sum(e[1] for e in each) * share
        for i, f in enumerate(COLS):
            for c in range(3):
                assert got[row["id"], f, c] == pytest.approx((phi[i, c], base[c], x[i]), abs=1e-9)


def test_a_single_leaf_and_repeated_keys(spark, table):
    model = MD.train_decision_tree(max_depth=0).fit(table)
    two = table.where("id < 2").unionByName(table.where("id < 2"))
    out = PT.tree_attribution(model, two, COLS, "id").collect()
    assert len(out) == 4 * 4 * 3 and all(r["phi"] == 0 for r in out)


def test_missing_values_go_right_and_both_ways_agree(spark, monkeypatch):
    """Leaves as arrays in the tasks, or joined with the rows: the same cells; NULL and NaN go right."""
    nodes = spark.createDataFrame([(0, 0, 0, 4.0, 1, 2, 10.0, []), (0, 1, 1, 2.0, 3, 4, 6.0, []), (0, 2, -1, None, -1, -1, 4.0, [0.0, 1.0]),
                                   (0, 3, 0, 1.0, 5, 6, 4.0, []), (0, 4, -1, None, -1, -1, 2.0, [0.5, 0.5]),
                                   (0, 5, -1, None, -1, -1, 3.0, [1.0, 0.0]), (0, 6, -1, None, -1, -1, 1.0, [0.25, 0.75])],
                                  "tree int, node int, feature int, threshold double, left int, right int, cover double, value array<double>")
    leaves = PT.leaf_paths(nodes)
    nan = float("nan")
    values = [(1.0, 2.0), (None, 1.0), (nan, 1.0), (3.0, None), (0.0, nan), (9.0, 9.0), (1.0, 2.0)]
    df = spark.createDataFrame([("k", *v) for v in values], "k string, a double, b double")

    def cells():
        out = PT.path_attribution(leaves, df, ["a", "b"], "k")
        assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString() or PT.MAX_LEAVES == 0
        return sorted((r["cls"], r["feature"], round(r["phi"], 12), str(r["x"]), round(r["base_value"], 12)) for r in out.collect())

    got = cells()
    assert len(got) == len(values) * 2 * 2
    right = next(p for c, f, p, x, _ in got if (c, f, x) == (1, "a", "9.0"))
    assert all(p > 0 for c, f, p, x, _ in got if (c, f) == (1, "a") and x in ("None", "nan")) and right > 0
    monkeypatch.setattr(PT, "MAX_LEAVES", 0)
    assert cells() == got


def test_many_leaves_in_small_blocks(monkeypatch):
    """Blocks of rows and leaves do not change what is paid."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 3))
    group = (rng.integers(0, 3, (40, 1)) + np.arange(2)) % 3, rng.normal(-1, 1, (40, 2)), rng.normal(1, 1, (40, 2)), rng.random((40, 2)) + 0.1, rng.normal(size=(40, 2))
    want = PT._paid(x, [group], 2)
    monkeypatch.setattr(PT, "BLOCK", 7)
    np.testing.assert_allclose(PT._paid(x, [group], 2), want, atol=1e-12)
