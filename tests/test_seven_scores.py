"""Seven scores of a table whose class hangs on one column alone."""

import numpy as np

from scorelens.operators import explain as X
from scorelens.operators import models as MD
from scorelens.plans import bind_models as B


def test_the_column_that_decides_ranks_first(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").selectExpr(
        "*", "CASE WHEN b < -0.4 THEN 0 WHEN b < 0.4 THEN 1 ELSE 2 END AS label").selectExpr(
        "*", "CAST(label AS double) AS label_index")
    cols = ["a", "b", "c"]
    specs = {"gbt": MD.ModelSpec("gbt", params={"rounds": 5, "depth": 3}),
             "forest": MD.ModelSpec("forest", params={"n_trees": 10, "max_depth": 4})}
    scores = B.seven_scores(MD.assemble(df, cols), cols, specs, repeats=3)
    assert set(scores.columns) == {"feature", *B.SCORES}
    got = X.ensemble_rank(scores, B.SCORES).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and got[0]["feature"] == "b"
    for c in B.SCORES:
        assert got[0][f"n_{c}"] > 0.999 and max(r[f"n_{c}"] for r in got[1:]) < 0.5
