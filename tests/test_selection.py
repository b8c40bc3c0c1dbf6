"""Selected quantiles and split cuts against pandas on small tables."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from scorelens.operators import prep
from scorelens.plans import rank


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"g": rng.integers(0, 3, 6000), "v": rng.lognormal(0, 3, 6000)})
    p.loc[::5, "v"] = 1.5                                   # a hot value
    return pd.concat([p, pd.DataFrame({"g": [9, 9, 9, 8], "v": [1.0, 2.0, 4.0, 7.0]})], ignore_index=True)


@pytest.mark.parametrize("margins", [rank._MARGINS, [(50, 0.1)], [(50, 1e-4)], [(1, 0.0)]])
def test_quantiles_with_good_and_bad_intervals(spark, table, margins):
    """Intervals that hold the position, ones that miss it, and groups without any."""
    probs = [0.9, 0.25, 0.5, 0.0, 1.0]
    df = spark.createDataFrame(table)
    got = {r["g"]: r["_q"] for r in rank.quantile_arrays(df, ["g"], "v", probs, 0.1, margins).collect()}
    assert set(got) == set(table.g)
    for g, x in table.groupby("g"):
        np.testing.assert_allclose(got[g], x.v.quantile(probs).values, rtol=1e-12)
    whole = rank.quantile_arrays(df, [], "v", probs, 0.1, margins).first()["_q"]
    np.testing.assert_allclose(whole, table.v.quantile(probs).values, rtol=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "g int, v double")
    assert [tuple(r) for r in rank.exact_quantiles(df, ["g"], "v", [0.5]).collect()] == [(2, 0.5, 3.0)]
    assert rank.exact_quantiles(df.where("v < 0"), [], "v", [0.5]).collect() == []


def _hash(k):
    return hashlib.md5(f"42|{k}".encode()).hexdigest()


@pytest.mark.parametrize("n,frac", [(0, 0.2), (1, 0.2), (997, 0.2), (997, 0.0), (997, 1.0)])
def test_random_split_is_a_prefix_of_the_hash_order(spark, n, frac):
    df = spark.range(n).selectExpr("id AS k")
    got = {r["k"] for r in prep.split_random(df, ["k"], frac, 42).where("split = 'test'").collect()}
    assert got == set(sorted(range(n), key=_hash)[:math.ceil(n * frac)])


def test_stratified_split_with_a_class_that_takes_no_row(spark):
    df = spark.range(1001).selectExpr("id AS k", "CASE WHEN id = 0 THEN 'rare' WHEN id % 3 = 0 THEN 'b' ELSE 'a' END AS c")
    got = prep.split_stratified(df, ["k"], "c", 0.2, 42).collect()
    assert len(got) == 1001 and sum(r["split"] == "test" for r in got) == 201
    for c in "ab":
        keys = sorted((r["k"] for r in got if r["c"] == c), key=_hash)
        test = {r["k"] for r in got if r["c"] == c and r["split"] == "test"}
        assert test == set(keys[:len(test)])


@pytest.mark.parametrize("frac", [0.25, 0.0, 1.0])
def test_time_split_with_ties_and_nulls(spark, frac):
    rows = [(i, None if i % 50 == 0 else i % 7) for i in range(400)]
    got = prep.split_time(spark.createDataFrame(rows, "k int, t int"), "t", ["k"], frac).collect()
    order = sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[0]))
    k = math.floor(400 * (1.0 - frac))
    assert {r["k"] for r in got if r["split"] == "train"} == {r[0] for r in order[:k]} and len(got) == 400


def test_intervals_go_to_the_rows(spark, table, monkeypatch):
    """Whatever the sizes, rows are not shuffled by group to meet their group's intervals."""
    seen = []
    monkeypatch.setattr(rank, "distributed_cumsum", lambda c, *_: seen.append(c) or c)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rank._selected(spark.createDataFrame(table), ["g"], "v", [0.5], 0.1, [(50, 0.1)])
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
