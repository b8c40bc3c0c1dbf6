import math

import duckdb
import numpy as np
import pytest

from scorelens.functions import pvalues as PV
from scorelens.functions.exprs import round_sig_sql


@pytest.mark.parametrize("df", [1, 2, 3, 4, 5, 7, 10, 25, 40])
@pytest.mark.parametrize("x", [0.3, 2.0, 9.5, 30.0])
def test_chi2_closed_form_matches_incomplete_gamma(df, x):
    v = duckdb.execute("SELECT " + PV.chi2_sf_sql(f"{x}e0", str(df))).fetchone()[0]
    ref = float(PV.chi2_sf(x, df))
    assert abs(v - ref) <= 1e-11 * max(ref, 1e-12) + 1e-15


def test_chi2_column_is_exact_for_any_df(spark):
    from pyspark.sql import functions as F
    # the last two by an independent evaluation of the incomplete gamma function
    xs = [(0.5, 3), (14.04, 3), (15.0, 3), (7.2, 4), (33.0, 40), (140.0, 60), (250.0, 100), (None, 3), (1.0, None), (0.0, 5)]
    df = spark.createDataFrame(xs, "x double, k int")
    got = [r[0] for r in df.select(PV.chi2_sf_column(F.col("x"), F.col("k"))).collect()]
    for (x, k), g in zip(xs[:5], got):
        d = duckdb.execute("SELECT " + PV.chi2_sf_sql(f"{x}e0", str(k))).fetchone()[0]
        assert abs(g - d) <= 1e-11 * abs(d)
    # even df: the Poisson sum, exact
    for (x, k), g in zip(xs[5:7], got[5:7]):
        want = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
        assert abs(g - want) <= 1e-12 * want
    assert got[5] == pytest.approx(2.43e-08, rel=2e-3) and got[7:] == [None, None, 1.0]


@pytest.mark.parametrize("x", [-4.0, -0.3, 0.0, 1e-3, 0.5, 1.7, 2.999, 3.0, 3.5, 6.0, 12.0])
def test_normal_tail_text_matches_erfc(x):
    v = duckdb.execute("SELECT " + PV.norm_sf_sql(f"({x}e0)")).fetchone()[0]
    want = 0.5 * math.erfc(x / math.sqrt(2))
    assert abs(v - want) <= 2e-11 * want


def test_published_friedman_p_values():
    # chi^2 15.0 and 14.04 with 3 df -> 0.0018166 and 0.0028512 (BASELINE)
    assert abs(float(PV.chi2_sf(15.0, 3)) - 0.0018166) < 1e-6
    assert abs(float(PV.chi2_sf(14.04, 3)) - 0.0028512) < 1e-6


def test_wilcoxon_exact():
    assert PV.wilcoxon_exact_p(0, 5) == pytest.approx(0.0625)
    assert PV.wilcoxon_exact_p(15, 5, "greater") == pytest.approx(1 / 32)
    assert PV.wilcoxon_exact_counts(4).sum() == 16


def test_t_distribution():
    assert float(PV.t_two_sided(2.0, 10)) == pytest.approx(0.07338803477, rel=1e-7)
    assert float(PV.t_two_sided(0.0, 5)) == pytest.approx(1.0)


def test_normal_tail_sql():
    v = duckdb.execute("SELECT " + PV.norm_sf_sql("1.96e0")).fetchone()[0]
    assert v == pytest.approx(0.5 * math.erfc(1.96 / math.sqrt(2)), rel=2e-7)


def test_round_sig_identical_in_both_engines(spark):
    vals = [1234567.123456789, 2.675, -0.000123456789123, 1e-15, 0.5, 99999.99999999]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = [r[0] for r in df.selectExpr(round_sig_sql("x")).collect()]
    d = [duckdb.execute("SELECT " + round_sig_sql(f"{v!r}::double")).fetchone()[0] for v in vals]
    assert np.array_equal(np.array(s, dtype=float), np.array(d, dtype=float))
