"""A written step leaves no shuffle files; the session's setting stays as it was."""

import pytest
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from scorelens.operators import importance as I
from scorelens.plans import helpers as H


def shuffle_files(spark) -> set:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString("\n")
    return {b for b in blocks.split("\n") if b.startswith("shuffle_")}


def shuffled(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v"))
    return df.groupBy("k").agg(F.sum("v").alias("s")).join(df.hint("merge"), "k")


def test_a_written_step_leaves_no_shuffle_files(spark):
    was, before = spark.conf.get(H.SHUFFLES_GO), shuffle_files(spark)
    assert H.checkpoint(shuffled(spark)).count() == 5000
    left = shuffle_files(spark) - before
    assert len({b.split("_")[1] for b in left}) <= 1          # of count() itself
    assert spark.conf.get(H.SHUFFLES_GO) == was
    with pytest.raises(RuntimeError), H.shuffles_go(spark), H.shuffles_go(spark):
        assert spark.conf.get(H.SHUFFLES_GO) == "true"
        raise RuntimeError
    assert spark.conf.get(H.SHUFFLES_GO) == was


def test_importance_is_the_same_in_any_batches(spark, monkeypatch):
    df = spark.range(400).selectExpr("id", "cast(id % 7 AS double) AS a", "cast(id % 5 AS double) AS b", "cast(id % 3 AS double) AS c", "cast(id % 7 > 3 AS int) AS y")
    model = SQLTransformer(statement="SELECT *, CASE WHEN a + 0.1 * b > 3.3 THEN 1 ELSE 0 END AS prediction FROM __THIS__")
    got = lambda: {tuple(r) for r in I.permutation_importance(model, df, ["a", "b", "c"], "y", "id", repeats=3).collect()}
    whole = got()
    monkeypatch.setattr(I, "BATCH_VALUES", 400)
    asked, rows = [], I.permuted_rows
    monkeypatch.setattr(I, "permuted_rows", lambda pos, features, *a: asked.append(list(features)) or rows(pos, features, *a))
    assert got() == whole and asked == [["a"], ["b"], ["c"]]
