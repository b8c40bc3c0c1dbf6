"""Ranks shared by three statistics, and cells added up once."""

import pytest

from pyspark.sql import functions as F
from scorelens.operators import explain as X
from scorelens.operators import models as MD
from scorelens.operators import stats


def _same(a, b, by):
    a, b = (sorted(d.collect(), key=lambda r: [str(r[c]) for c in by]) for d in (a, b))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for c, v in y.asDict().items():
            assert x[c] == (pytest.approx(v, rel=1e-12, nan_ok=True) if isinstance(v, float) else v), (c, y)


@pytest.mark.parametrize("rare", [0, 2])
def test_shared_ranks_change_nothing(spark, rare):
    """Also with a class too small for Kruskal-Wallis, and missing values and classes."""
    rows = [(i % 4 if i % 9 else None, float(i * 7 % 13), None if i % 5 == 0 else float(i % 6)) for i in range(90)]
    df = spark.createDataFrame(rows + [(9, 1.5, 2.5)] * rare, "g int, a double, b double")
    r = stats.feature_ranks(df, ["a", "b"], "g")
    for f in (stats.spearman_with_target, stats.kruskal_wallis, stats.mutual_information):
        _same(f(df, ["a", "b"], "g", ranked=r), f(df, ["a", "b"], "g"), ["feature"])


def test_class_matrix_reads_its_cells_once(spark):
    rows = [(c, f, None if (c, i) == (1, 0) else (c - 1.5) * k * (i + 1)) for c in (1, 2) for k, f in enumerate("uvwx") for i in range(5)]
    cells = spark.createDataFrame(rows + [(1, "z", None)], "cls int, feature string, phi double")
    out = X.attribution_class_matrix(cells, 2)
    means = cells.groupBy("feature").agg(F.avg(F.abs("phi")).alias("m")).orderBy(F.col("m").desc(), "feature").limit(2).select("feature")
    _same(out, cells.join(means, "feature", "left_semi").groupBy("cls", "feature").agg(F.avg("phi").alias("mean_phi")), ["cls", "feature"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + out._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 1


def test_stacked_rows_are_dealt_by_their_size(spark, monkeypatch):
    df = MD.assemble(spark.createDataFrame([(float(i % 3), float(i % 3) + i % 2) for i in range(60)], "label_index double, x double"), ["x"]).coalesce(1)
    whole = MD.OrdinalLogistic(reg=1e-2).fit(df)
    seen = []
    stack = MD.OrdinalLogistic._stack
    monkeypatch.setattr(MD.OrdinalLogistic, "_stack", lambda self, d: (seen.append(d.rdd.getNumPartitions()), stack(self, d))[1])
    monkeypatch.setattr(MD, "PART_BYTES", 1000)
    dealt = MD.OrdinalLogistic(reg=1e-2).fit(df)
    assert seen == [3]          # 60 rows x 2 thresholds x 3 numbers of 8 bytes
    assert dealt.slope == pytest.approx(whole.slope, rel=1e-6) and dealt.cuts == pytest.approx(whole.cuts, rel=1e-6)
