"""Attribution per row over all features, equal to its SQL."""

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as E
from scorelens.operators import explain as X
from scorelens.plans import views as V

from conftest import SF_SMALL
from test_registry import _compare


@pytest.mark.parametrize("name", [f"{n}{s}" for n in ("linear_attribution", "attribution_waterfall", "attribution_points") for s in ("", "_all")])
def test_every_feature_of_every_row(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert {r[0] for r in df.select("feature").distinct().collect()} == set(V.FEATURES)
    _compare(spark, name, SF_SMALL)


@pytest.mark.parametrize("name", ["linear_attribution", "attribution_waterfall", "attribution_points"])
def test_rows_are_not_shuffled(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


CELLS = [(key, own, cls, f, phi * cls, x) for key, own, row in [
    ("a", 1, [3.0, -4.0]), ("b", 2, [5.0, None]), ("c", 1, [1.0, 1.0]), ("c", 2, [2.0, 0.5]), ("d", None, [7.0, 7.0]),
    ("e", 1, [6.0, 2.0]), ("e", None, [8.0, 9.0]), ("g", 2, [1.5, 2.5]), ("g", 2, [1.5, 2.5])]
    for cls in (1, 2) for f, x in zip("uv", row) for phi in [x if x is not None else float("nan")]]


def _cells(spark):
    df = spark.createDataFrame(CELLS, "k string, own int, cls int, feature string, phi double, x double")
    return df.withColumn("phi", F.nanvl("phi", F.lit(None)))


def test_waterfall_by_a_column_equals_a_join(spark):
    """Keys that repeat, with one class, several, or none."""
    cells = _cells(spark)
    by_join = X.attribution_waterfall(cells, "k", 3, cells.select("k", F.col("own").alias("cls")).distinct())
    by_column = X.attribution_waterfall(cells, "k", 3, "own")
    show = lambda d: sorted(map(str, d.select("k", "cls", "feature", "phi", "step", "cum_phi").collect()))
    assert show(by_column) == show(by_join)
    single = X.attribution_waterfall(cells.where("k IN ('a', 'b', 'g')"), "k", 3, "own")
    assert "Join" not in single._jdf.queryExecution().executedPlan().toString()


def test_points_of_sparse_cells(spark):
    cells = _cells(spark).where("NOT (k = 'a' AND feature = 'v')")
    got = {(r["k"], r["feature"]): (r["phi_sum"], r["x_scaled"]) for r in X.attribution_points(cells, "k", 2).collect()}
    assert set(got) == {(k, f) for k in "abcdeg" for f in "uv"} - {("a", "v")}
    assert got["a", "u"][0] == pytest.approx(9.0) and got["d", "u"][0] == pytest.approx(21.0)
    assert got["b", "v"] == (None, None) and got["g", "v"][0] == pytest.approx(15.0)
    plan = X.attribution_points(cells, "k", 2)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan       # what is returned is made inside the rows


def test_modes_come_from_counts(spark):
    from scorelens.operators import prep
    df = spark.createDataFrame([(1, 2.0, "b"), (2, 2.0, "a"), (3, 7.0, "b"), (4, None, "a"), (5, 7.0, None), (6, None, None)],
                               "k int, x double, c string").withColumn("none", prep.F.lit(None).cast("string"))
    got = prep.impute_mode_cat(prep.impute_stat(df, ["x"], "most_frequent"), ["c", "none"])
    assert {r["k"]: (r["x"], r["c"], r["none"]) for r in got.collect()} == {
        1: (2.0, "b", "Unknown"), 2: (2.0, "a", "Unknown"), 3: (7.0, "b", "Unknown"), 4: (2.0, "a", "Unknown"),
        5: (7.0, "a", "Unknown"), 6: (2.0, "a", "Unknown")}
    assert "mode(" not in got._jdf.queryExecution().toString()
