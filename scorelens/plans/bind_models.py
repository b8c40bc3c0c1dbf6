"""Rows-checked bindings for training, PCA, importance, attribution and scoring.

Model fitting is randomised / iterative, so these have no SQL oracle. They train on
the ``W2`` view (every row of ``embeddings``, its 64 numbers as columns, label =
class) and are checked for schema, row count and quality in tests.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scorelens.operators import explain as X
from scorelens.operators import importance as I
from scorelens.operators import models as MD
from scorelens.operators import paths as PT
from scorelens.operators import permute as PM
from scorelens.operators import prep, stats
from scorelens.plans import views as V
from scorelens.plans.registry import register
from scorelens.sources import io

DIMS = [f"e{i}" for i in range(V.EMB_DIM)]
CLASSES = list(range(10))
# the reference's settings
SPECS = {"logistic": MD.ModelSpec("logistic", params={"max_iter": 200}),
         "tree": MD.ModelSpec("tree", params={"max_depth": 8, "min_leaf": 10}),
         "forest": MD.ModelSpec("forest", params={"n_trees": 300, "max_depth": 16}),
         "gbt": MD.ModelSpec("gbt", params={"rounds": 300, "step": 0.05, "leaves": 31, "depth": 6}),
         "ordinal": MD.ModelSpec("ordinal", params={"reg": 1e-4})}
SEEDS = [42, 142, 242, 342, 442]


def labelled(df):
    """W2 rows with a class (label) from 0 and the id's name used below."""
    return (df.withColumnRenamed("vec_id", "id").where(F.col("label").isNotNull())
              .withColumn("label_index", F.col("label").cast("double")))


def data(spark, sf, cols=None):
    return MD.assemble(labelled(V.w2(spark, sf)), cols or DIMS)


def split(df, seed=42):
    d = prep.split_stratified(df, ["id"], "label", 0.2, seed)
    return d.where("split = 'train'"), d.where("split = 'test'")


def _eval(spark, sf, spec, cols=None, seed=42):
    tr, te = split(data(spark, sf, cols), seed)
    res, _ = MD.evaluate_model(spec, tr, te, n_classes=len(CLASSES), seed=seed)
    return spark.createDataFrame([(spec.label, *[float(res[k]) if res[k] is not None else None for k in
                                                 ("accuracy", "macro_f1", "micro_f1", "macro_auroc", "micro_auroc",
                                                  "fit_seconds")])],
                                 "model string, accuracy double, macro_f1 double, micro_f1 double, "
                                 "macro_auroc double, micro_auroc double, fit_seconds double")


@register("train_logistic")
def q_train_logistic(spark, sf):
    return _eval(spark, sf, SPECS["logistic"])


@register("train_decision_tree")
def q_train_tree(spark, sf):
    return _eval(spark, sf, SPECS["tree"])


@register("train_random_forest")
def q_train_forest(spark, sf):
    return _eval(spark, sf, SPECS["forest"])


@register("train_boosted_trees")
def q_train_gbt(spark, sf):
    return _eval(spark, sf, SPECS["gbt"])


@register("train_ordinal_logistic")
def q_train_ordinal(spark, sf):
    return _eval(spark, sf, SPECS["ordinal"])


@register("evaluate_model")
def q_evaluate_model(spark, sf):
    return _eval(spark, sf, MD.ModelSpec("tree", "tree_depth4", {"max_depth": 4}))


def weigh(train, test):
    """Balanced class weights of the train rows (the test rows need none)."""
    return prep.balanced_class_weight(train, "label", "w"), test.withColumn("w", F.lit(1.0))


@register("run_repeated")
def q_run_repeated(spark, sf):
    return MD.run_repeated(list(SPECS.values()), data(spark, sf), SEEDS,
                           conditions={"unweighted": None, "weighted": "w"}, split=split, prepare=weigh)


@register("strategy_benchmark")
def q_strategy_benchmark(spark, sf):
    """One seed, as the reference's table of strategies; what a strategy learns, it
    learns from the train rows."""
    base = data(spark, sf)

    def best_mi(tr, te):
        chosen = [r["feature"] for r in prep.select_k_best_mi(tr, DIMS, "label", k=25).collect()]
        return tuple(MD.assemble(d.drop("features"), chosen) for d in (tr, te))

    out = None
    for name, prepare in (("all", None), ("mi_top25", best_mi), ("pca95", lambda tr, te: MD.pca_on_train(tr, te, 0.95)[1:])):
        r = MD.run_repeated(list(SPECS.values()), base, [42], split=split, prepare=prepare,
                            extra={"strategy": name})
        out = r if out is None else out.unionByName(r)
    return out


@register("ablation_excluded")
def q_ablation(spark, sf):
    """One seed, as the reference's ablation: every fourth column left out."""
    d = data(spark, sf, [c for i, c in enumerate(DIMS) if i % 4 != 3])
    return MD.run_repeated(list(SPECS.values()), d, [42], split=split, extra={"excluded": "every_fourth"})


@register("preprocess_pipeline")
def q_preprocess_pipeline(spark, sf):
    w = V.w1n(spark, sf)
    d = prep.split_random(w, ["row_key"], 0.2, 42)
    pipe = prep.preprocess_pipeline(V.FEATURES, V.SEGMENTS)
    model = pipe.fit(d.where("split = 'train'"))
    return model.transform(d.where("split = 'test'")).select("row_key", vector_to_array("features").alias("features"))


@register("pca_variance")
def q_pca_variance(spark, sf):
    k, res, _ = MD.pca_variance(data(spark, sf), 0.95)
    return res.select("id", F.lit(k).alias("k"), vector_to_array("pca").alias("pca"))


@register("pca_fixed_k")
def q_pca_fixed_k(spark, sf):
    res, _ = MD.pca_fixed_k(data(spark, sf), 5)
    return res.select("id", vector_to_array("pca").alias("pca"))


@register("pca_scree")
def q_pca_scree(spark, sf):
    return MD.pca_scree(data(spark, sf))


@register("native_importance")
def q_native_importance(spark, sf):
    tr, _ = split(data(spark, sf))
    m = MD.train_random_forest(n_trees=300, max_depth=16).fit(tr)
    return I.native_importance(m, DIMS)


@register("native_importance_seeds")
def q_native_importance_seeds(spark, sf):
    tr, _ = split(data(spark, sf))
    return I.native_importance_seeds(SPECS["tree"], tr, DIMS, SEEDS)


class _LRPipeline:
    """Assembler + scaler + multinomial logistic; regParam = 1 / (C * n_train)
    needs the training row count, so it is resolved at fit time."""

    def __init__(self, cols):
        self.cols = cols

    def fit(self, train):
        train = train.persist()          # one pass per optimiser iteration
        try:
            n = float(train.count())
            return Pipeline(stages=[VectorAssembler(inputCols=self.cols, outputCol="__raw"),
                                    StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True),
                                    MD.train_logistic(n_rows=n, max_iter=200)]).fit(train)
        finally:
            train.unpersist()


def _lr_pipeline(cols):
    return _LRPipeline(cols)


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    s = data(spark, sf).drop("features")
    tr, te = split(s)
    model = _lr_pipeline(DIMS).fit(tr)
    return I.permutation_importance(model, te, DIMS, "label_index", "id", repeats=15)


SCORES = ["logistic_native", "logistic_perm", "gbt_native", "gbt_perm", "forest_native", "forest_perm", "eta2"]


def seven_scores(df, cols, specs, repeats, seed=42):
    """Native and permutation importance of three models and eta2, one row per feature.
    Models learn from the training rows, permutations are over the test rows, eta2 is of
    all rows. The logistic model sees scaled columns."""
    raw = df.drop("features")
    tr, te = split(raw, seed)
    linear = _lr_pipeline(cols).fit(tr)
    models = {"logistic": (linear, linear)}
    x = MD.sized(MD.assemble(tr, cols))
    for name in ("gbt", "forest"):
        m = MD.build_estimator(specs[name], "features", "label_index", None, float(x.count()), seed).fit(x)
        models[name] = (m, I.OnColumns(m, cols))
    eta = stats.kruskal_wallis(df, cols, "label").select("feature", "eta2")
    return I.model_scores(models, te, cols, "label_index", "id", repeats, seed).join(eta, "feature")


@register("ensemble_rank_models")
def q_ensemble_rank_models(spark, sf):
    """I-05 with its seven scores."""
    return X.ensemble_rank(seven_scores(data(spark, sf), DIMS, SPECS, 15), SCORES)


# A given model over the order lines: the price band of a line from its quantity, the
# part's price, discount and tax (the other columns must come out with no drop).
_GIVEN = ["l_quantity", "l_discount", "l_tax", "p_retailprice", "p_size", "c_acctbal", "o_totalprice"]
_GIVEN_REPEATS = 3


def _band(x):
    return f"(CASE WHEN {x} < 15000 THEN 0 WHEN {x} < 30000 THEN 1 WHEN {x} < 50000 THEN 2 ELSE 3 END)"


_GIVEN_PRED = _band("l_quantity * p_retailprice * (1 - l_discount) * (1 + l_tax)")


def _given_sql():
    """The same permutations; repetitions outside 0 .. n-1 by recursion."""
    keys = [f"g.k{j}" for j in range(PM.N_KEYS)]
    rows = ", ".join(f"('{f}', {r}, " + ", ".join(f"{k}::BIGINT" for k in PM.permutation_keys(42, f, r)) + ")"
                     for f in _GIVEN for r in range(_GIVEN_REPEATS))
    # the grid's sides depend on n, which is a column here
    step = lambda x: PM.rounds_sql(x, "g.a", "g.b", keys, "//")           # noqa: E731
    ks = ", ".join(f"k{j}" for j in range(PM.N_KEYS))
    gks = ", ".join(keys)
    swapped = ", ".join(f"CASE WHEN m.feature = '{f}' THEN d.{f} ELSE t.{f} END AS {f}" for f in _GIVEN)
    return f"""
WITH RECURSIVE base AS (SELECT row_number() OVER (ORDER BY row_key) - 1 AS pos, {_band('l_extendedprice')} AS y,
    {', '.join(_GIVEN)} FROM ({V.W1_SQL}) w1),
size AS (SELECT n, a, cast((n + a - 1) // a AS bigint) AS b FROM (SELECT n, cast(ceil(sqrt(n)) AS bigint) AS a
    FROM (SELECT count(*) AS n FROM base) c) s),
g AS (SELECT * FROM (VALUES {rows}) v(feature, repeat, {ks}) CROSS JOIN size),
walk AS (SELECT g.*, base.pos, {step('base.pos')} AS x FROM base CROSS JOIN g
    UNION ALL SELECT g.feature, g.repeat, {gks}, g.n, g.a, g.b, g.pos, {step('g.x')} AS x FROM walk g WHERE g.x >= g.n),
moved AS (SELECT feature, repeat, pos, x FROM walk WHERE x < n),
rows_in AS (SELECT m.feature, m.repeat, t.y, {swapped} FROM moved m JOIN base t ON t.pos = m.x JOIN base d ON d.pos = m.pos
    UNION ALL SELECT '', 0, y, {', '.join(_GIVEN)} FROM base),
pred AS (SELECT feature, repeat, y, {_GIVEN_PRED} AS yhat FROM rows_in),
cls AS (SELECT feature, repeat, k, sum(tp) AS tp, sum(nt) AS nt, sum(np) AS np FROM (
    SELECT feature, repeat, y AS k, CASE WHEN y = yhat THEN 1 ELSE 0 END AS tp, 1 AS nt, 0 AS np FROM pred
    UNION ALL SELECT feature, repeat, yhat, 0, 0, 1 FROM pred) u GROUP BY feature, repeat, k),
f1 AS (SELECT feature, repeat, avg(2e0 * tp / (nt + np)) AS score FROM cls GROUP BY feature, repeat)
SELECT f.feature, avg(z.score - f.score) AS mean_drop, coalesce(stddev_samp(z.score - f.score), 0) AS std_drop,
    count(*) AS n_repeats, any_value(z.score) AS baseline
FROM f1 f CROSS JOIN (SELECT score FROM f1 WHERE feature = '') z WHERE f.feature <> '' GROUP BY f.feature
"""


@register("permutation_importance_given", dbl=["mean_drop", "std_drop", "baseline"], sql=_given_sql())
def q_permutation_given(spark, sf):
    w = V.w1(spark, sf).select("row_key", *_GIVEN, F.expr(_band("l_extendedprice")).alias("y"))
    model = SQLTransformer(statement=f"SELECT *, {_GIVEN_PRED} AS prediction FROM __THIS__")
    return I.permutation_importance(model, w, _GIVEN, "y", "row_key", repeats=_GIVEN_REPEATS)


@register("tree_attribution")
def q_tree_attribution(spark, sf):
    tr, te = split(data(spark, sf))
    m = MD.train_decision_tree(max_depth=8, min_leaf=10).fit(tr)
    return PT.tree_attribution(m, te, DIMS, "id")


@register("boosted_attribution")
def q_boosted_attribution(spark, sf):
    """Margins of boosted trees, explained."""
    tr, te = split(data(spark, sf))
    m = MD.train_boosted_trees(rounds=20, step=0.05, leaves=31, depth=6).fit(tr)
    return PT.tree_attribution(m, te, DIMS, "id")


@register("whatif_scenarios")
def q_whatif(spark, sf):
    s = data(spark, sf).drop("features")
    tr, _ = split(s)
    model = _lr_pipeline(DIMS).fit(tr)
    return I.whatif_scenarios(model, tr, DIMS, ["e0", "e7"], steps=100, n_classes=len(CLASSES))


def _saved_model(spark, sf):
    """A fitted pipeline, written to the shared folder and loaded again; and the test rows."""
    tr, te = split(data(spark, sf).drop("features"))
    path = MD.save_pipeline(_lr_pipeline(DIMS).fit(tr), io.output_root(spark, "model"))
    return MD.load_pipeline(path), te


@register("batch_score")
def q_batch_score(spark, sf):
    model, te = _saved_model(spark, sf)
    return I.batch_score(model, te, class_labels=CLASSES, keep=["id"])


@register("batch_score_stream")
def q_batch_score_stream(spark, sf):
    """I-19 on a stream: embeddings arrive as a file stream, the saved pipeline is
    applied per micro-batch, output lands in a table."""
    from scorelens.streaming.score import run_to_table, score_stream
    model, _ = _saved_model(spark, sf)
    schema = V.read(spark, sf, "embeddings").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/embeddings.parquet*")
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(V.EMB_DIM)]
    scored = score_stream(model, stream.select(F.col("vec_id").alias("id"), *cols), CLASSES, keep=["id"])
    root = io.output_root(spark, "stream")
    run_to_table(scored, f"{root}/_checkpoint", f"{root}/data")
    return spark.read.parquet(f"{root}/data")
