"""Models, evaluation and repeated runs on MLlib (SURVEY §2.7 M-01 … M-05,
M-10, M-11, M-16, M-17; §2.6 P-16 … P-18).

Training is MLlib (distributed optimisers / tree builders), ``boosting`` and ``forest``. Scoring returns
``prob_{k}`` columns so every metric of ``metrics.py`` (ranks, counts) runs
as a Spark job on the prediction table.
"""

from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.operators import metrics as M
from scorelens.operators.boosting import PART_BYTES, BoostedModel, Boosting, fit_boosted
from scorelens.operators.forest import RandomForest


@dataclass
class ModelSpec:
    """A named model family with its hyper-parameters."""
    kind: str                        # logistic | tree | forest | gbt | ordinal
    name: str | None = None
    params: dict = field(default_factory=dict)

    @property
    def label(self) -> str:
        return self.name or self.kind


# ------------------------------------------------------------------ builders
def train_logistic(features: str = "features", label: str = "label_index", weight: str | None = None,
                   C: float = 1.0, n_rows: float | None = None, max_iter: int = 200) -> LogisticRegression:
    """M-01: multinomial L2 logistic regression. sklearn's C maps to
    regParam = 1 / (C * n) (the sum of weights when weighted)."""
    lr = LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", elasticNetParam=0.0,
                            regParam=(1.0 / (C * n_rows)) if n_rows else 0.0, standardization=False, maxIter=max_iter)
    if weight:
        lr.setWeightCol(weight)
    return lr


def train_decision_tree(features: str = "features", label: str = "label_index", weight: str | None = None,
                        max_depth: int = 8, min_leaf: int = 1, seed: int = 42) -> DecisionTreeClassifier:
    """M-02: CART tree (Gini). ``min_leaf`` = minInstancesPerNode; MLlib has no
    min-samples-split setting."""
    dt = DecisionTreeClassifier(featuresCol=features, labelCol=label, maxDepth=max_depth,
                                minInstancesPerNode=min_leaf, seed=seed)
    if weight:
        dt.setWeightCol(weight)
    return dt


def train_random_forest(features: str = "features", label: str = "label_index", weight: str | None = None,
                        n_trees: int = 200, max_depth: int = 16, seed: int = 42) -> RandomForest:
    """M-03: an estimator of random forests (``forest``; depth capped at 30)."""
    return RandomForest(features, label, weight, trees=n_trees, depth=min(max_depth, 30), seed=seed)


class BoostedTrees:
    """M-04: multi-class gradient boosting (``boosting``)."""

    def __init__(self, features: str = "features", label: str = "label_index", weight: str | None = None,
                 n_classes: int | None = None, **settings):
        self.features, self.label, self.weight, self.n_classes = features, label, weight, n_classes
        self.settings = Boosting(**settings)

    def fit(self, df: DataFrame) -> BoostedModel:
        k = self.n_classes or int(df.agg(F.max(self.label)).first()[0]) + 1
        return fit_boosted(df, k, self.settings, self.features, self.label, self.weight)[0]


def train_boosted_trees(features: str = "features", label: str = "label_index", weight: str | None = None,
                        n_classes: int | None = None, **settings) -> BoostedTrees:
    """M-04: an estimator of boosted trees; ``settings`` are those of ``Boosting``."""
    return BoostedTrees(features, label, weight, n_classes, **settings)


class OrdinalLogistic:
    """M-05: all-threshold ordinal logistic model: one slope vector shared by the K-1
    thresholds, fitted as one binary logistic regression on the rows stacked once per
    threshold (is y > t?) with an indicator of the threshold as further features.
    ``reg`` (alpha) is the L2 penalty on the slopes relative to the rows' total weight;
    the indicators are scaled up so that their share of it does not count."""

    INDICATOR = 100.0

    def __init__(self, features: str = "features", label: str = "label_index", reg: float = 0.0,
                 weight: str | None = None):
        self.features, self.label, self.reg, self.weight = features, label, reg, weight
        self.k = 0

    def _stack(self, df: DataFrame) -> DataFrame:
        t = F.explode(F.sequence(F.lit(0), F.lit(self.k - 2))).alias("__t")
        cols = [self.features, self.label] + ([self.weight] if self.weight else [])
        s = df.select(*cols, t)
        which = F.transform(F.sequence(F.lit(0), F.lit(self.k - 2)),
                            lambda i: F.when(i == F.col("__t"), F.lit(self.INDICATOR)).otherwise(F.lit(0.0)))
        return s.select(array_to_vector(F.concat(vector_to_array(self.features), which)).alias("__x"),
                        (F.col(self.label) > F.col("__t")).cast("double").alias("__gt"),
                        *([self.weight] if self.weight else []))

    def fit(self, df: DataFrame) -> "OrdinalLogistic":
        self.k = int(df.agg(F.max(self.label)).collect()[0][0]) + 1
        if self.k < 2:
            raise ValueError("an ordinal model needs two classes at least")
        lr = LogisticRegression(featuresCol="__x", labelCol="__gt", family="binomial", fitIntercept=False,
                                regParam=self.reg, standardization=False, maxIter=200)
        if self.weight:
            lr.setWeightCol(self.weight)
        # a row is stacked k - 1 times and wider: partitions follow the stacked size
        n, p = df.agg(F.count(F.lit(1)), F.max(F.size(vector_to_array(self.features)))).first()
        parts = math.ceil(n * (self.k - 1) * 8 * ((p or 1) + self.k - 1) / PART_BYTES)
        if parts > 1:
            df = df.repartition(parts)
        d = self._stack(df).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            w = lr.fit(d).coefficients.toArray()
        finally:
            d.unpersist()
        p = len(w) - (self.k - 1)
        self.slope = [float(x) for x in w[:p]]
        # P(y > t) falls with t
        self.cuts = sorted((float(x) * self.INDICATOR for x in w[p:]), reverse=True)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        s = F.aggregate(F.zip_with(vector_to_array(self.features), F.array(*[F.lit(x) for x in self.slope]),
                                   lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        out = df.withColumn("__s", s)
        for t, c in enumerate(self.cuts):
            out = out.withColumn(f"__gt{t}", 1.0 / (1.0 + F.exp(-(F.col("__s") + F.lit(c)))))
        out = out.drop("__s")
        mono = [F.col(f"__gt{t}") for t in range(self.k - 1)]
        probs = [1 - mono[0]] + [mono[t - 1] - mono[t] for t in range(1, self.k - 1)] + [mono[-1]]
        arr = F.array(*[F.greatest(p, F.lit(0.0)) for p in probs])
        out = out.withColumn("__p", arr).drop(*[f"__gt{t}" for t in range(self.k - 1)])
        return out.withColumn("probability", array_to_vector("__p")).withColumn(
            "prediction", (F.array_position("__p", F.array_max("__p")) - 1).cast("double")).drop("__p")


def build_estimator(spec: ModelSpec, features: str, label: str, weight: str | None, n_rows: float, seed: int):
    p = dict(spec.params)
    if spec.kind == "logistic":
        return train_logistic(features, label, weight, C=p.get("C", 1.0), n_rows=n_rows,
                              max_iter=p.get("max_iter", 200))
    if spec.kind == "tree":
        return train_decision_tree(features, label, weight, p.get("max_depth", 8), p.get("min_leaf", 1), seed)
    if spec.kind == "forest":
        return train_random_forest(features, label, weight, p.get("n_trees", 200), p.get("max_depth", 16), seed)
    if spec.kind == "gbt":
        return train_boosted_trees(features, label, weight, **p)
    if spec.kind == "ordinal":
        return OrdinalLogistic(features, label, p.get("reg", 0.0), weight)
    raise ValueError(spec.kind)


# -------------------------------------------------------------------- scoring
def with_class_probs(pred: DataFrame, n_classes: int) -> DataFrame:
    """``prob_{k}`` columns (k = 0..K-1) from ``probability``."""
    pred = pred.withColumn("__pa", vector_to_array("probability"))
    return pred.select("*", *[F.col("__pa")[k].alias(f"prob_{k}") for k in range(n_classes)]).drop("__pa")


def score_metrics(pred: DataFrame, label: str, n_classes: int) -> dict:
    """Accuracy, macro / micro F1, macro / micro AUROC of a prediction table."""
    probs = {k: f"prob_{k}" for k in range(n_classes)}
    p = pred.select(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat"),
                    *probs.values()).cache()
    try:
        f1 = M.f1_accuracy(p, "y", "yhat").collect()[0]
        au = {r["scope"]: r["auc"] for r in M.auroc_ovr(p, "y", probs).where("scope <> 'class'").collect()}
    finally:
        p.unpersist()
    return {"accuracy": f1["accuracy"], "macro_f1": f1["macro_f1"], "micro_f1": f1["micro_f1"],
            "macro_auroc": au.get("macro"), "micro_auroc": au.get("micro")}


NEEDS_SCALING = ("logistic", "ordinal")


def sized(df: DataFrame, features: str = "features") -> DataFrame:
    """``df`` persisted in partitions of at most about ``PART_BYTES`` of feature values."""
    from scorelens.plans.helpers import checkpoint
    src = df if df.is_cached else checkpoint(df)
    n, p = src.agg(F.count(F.lit(1)), F.max(F.size(vector_to_array(features)))).first()
    return src.coalesce(max(1, math.ceil(n * 8 * (p or 1) / PART_BYTES))).persist(StorageLevel.MEMORY_AND_DISK)


def scale_for_linear(train: DataFrame, test: DataFrame, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """Features centred and scaled by the train rows' moments (both splits)."""
    sc = StandardScaler(inputCol=features, outputCol="__zf", withMean=True, withStd=True).fit(train)
    fix = lambda d: sc.transform(d).drop(features).withColumnRenamed("__zf", features)
    return fix(train), fix(test)


def evaluate_model(spec: ModelSpec, train: DataFrame, test: DataFrame, features: str = "features",
                   label: str = "label_index", n_classes: int | None = None, weight: str | None = None,
                   seed: int = 42, fitted=None) -> tuple[dict, object]:
    """M-10: fit, predict, all metrics and the fit seconds. Linear kinds get features
    scaled on the train rows. ``fitted``: (model, seconds), if it has been fitted."""
    if fitted is not None:
        return score_metrics(with_class_probs(fitted[0].transform(test), n_classes), label, n_classes) | {"fit_seconds": fitted[1]}, fitted[0]
    if spec.kind in NEEDS_SCALING:
        train, test = scale_for_linear(train, test, features)
    # iterative fits make one pass per iteration: keep the inputs materialised, in as
    # many partitions as their size asks for
    train, test = sized(train, features), sized(test, features)
    owned = [train, test]
    try:
        n_classes = n_classes or int(train.agg(F.max(label)).collect()[0][0]) + 1
        n_rows = float(train.agg(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).collect()[0][0])
        est = build_estimator(spec, features, label, weight, n_rows, seed)
        t0 = time.time()
        model = est.fit(train)
        fit_s = time.time() - t0
        pred = with_class_probs(model.transform(test), n_classes)
        res = score_metrics(pred, label, n_classes)
        res["fit_seconds"] = fit_s
    finally:
        for d in owned:
            d.unpersist()
    return res, model


def run_repeated(specs: list[ModelSpec], data: DataFrame, seeds: list[int], features: str = "features",
                 label: str = "label_index", conditions: dict[str, str | None] | None = None,
                 split=None, parallel: int = 6, extra: dict | None = None, prepare=None) -> DataFrame:
    """M-11: models x seeds x conditions -> long score cube
    ``(seed, condition, model, metric, value)``. ``split(data, seed)`` returns
    (train, test); ``prepare(train, test)`` may replace both by what it learns from the
    train rows (weights, projections); conditions map a name to a weight column (or None).
    Fits are submitted from a small thread pool (concurrent Spark jobs)."""
    spark = data.sparkSession
    conditions = conditions or {"unweighted": None}
    n_classes = int(data.agg(F.max(label)).collect()[0][0]) + 1
    splits = {}
    for s in seeds:
        tr, te = split(data, s)
        if prepare is not None:
            tr, te = prepare(tr, te)
        splits[s] = (tr.cache(), te.cache())

    # boosted models of all seeds and conditions grow in the same jobs
    grown: dict = {}
    for spec in (x for x in specs if x.kind == "gbt"):
        runs = [(s, c, w) for s in seeds for c, w in conditions.items()]
        t0, rows = time.time(), None
        for i, (s, _, w) in enumerate(runs):
            r = splits[s][0].select(F.lit(i).alias("__fit"), features, label, (F.col(w) if w else F.lit(1.0)).cast("double").alias("__w"))
            rows = r if rows is None else rows.unionByName(r)
        models = fit_boosted(rows, n_classes, Boosting(**spec.params), features, label, "__w", "__fit")
        seconds = (time.time() - t0) / len(runs)
        grown |= {(s, c, spec.label): (models[i], seconds) for i, (s, c, _) in enumerate(runs)}

    def one(job):
        s, cond, w, spec = job
        tr, te = splits[s]
        res, _ = evaluate_model(spec, tr, te, features, label, n_classes, w, seed=s, fitted=grown.get((s, cond, spec.label)))
        return [(s, cond, spec.label, m, float(v) if v is not None else None) for m, v in res.items()]

    jobs = [(s, c, w, spec) for s in seeds for c, w in conditions.items() for spec in specs]
    rows = []
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as ex:
        for r in ex.map(one, jobs):
            rows.extend(r)
    for tr, te in splits.values():
        tr.unpersist()
        te.unpersist()
    cols = "seed int, condition string, model string, metric string, value double"
    out = spark.createDataFrame(rows, cols)
    for k, v in (extra or {}).items():
        out = out.withColumn(k, F.lit(v))
    return out


# ----------------------------------------------------------------------- PCA
def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def _centred_scaled(df: DataFrame, features: str):
    """Centre and scale to population std (sklearn StandardScaler): MLlib's
    scaler uses the sample std, so its output is multiplied by sqrt((n-1)/n).
    The input is written once (scaler fit, PCA fit and transform each read it)."""
    from scorelens.plans.helpers import checkpoint
    df = checkpoint(df)
    sc = StandardScaler(inputCol=features, outputCol="__z", withMean=True, withStd=True).fit(df)
    n = df.count()
    k = ((n - 1) / n) ** 0.5 if n > 1 else 1.0
    z = sc.transform(df).withColumn("__z", array_to_vector(F.transform(vector_to_array("__z"), lambda v: v * k)))
    return z, sc


def _full_pca(df: DataFrame, features: str):
    """(scaled rows, PCA of all components): one scaler fit, one PCA fit."""
    z, _ = _centred_scaled(df, features)
    meta = df.schema[features].metadata.get("ml_attr", {})
    p = int(meta["num_attrs"]) if "num_attrs" in meta else int(len(z.select("__z").first()[0]))
    return z, PCA(k=p, inputCol="__z", outputCol="__pc").fit(z)


def _scree_rows(model) -> list[tuple[int, float, float]]:
    rows, cum = [], 0.0
    for i, v in enumerate(model.explainedVariance):
        cum += float(v)
        rows.append((i + 1, float(v), cum))
    return rows


def pca_scree(df: DataFrame, features: str = "features") -> DataFrame:
    """P-18: explained-variance share per component and cumulative share."""
    _, model = _full_pca(df, features)
    return df.sparkSession.createDataFrame(_scree_rows(model), "component int, share double, cumulative double")


def pca_fixed_k(df: DataFrame, k: int, features: str = "features", out: str = "pca") -> tuple[DataFrame, object]:
    """P-17: project centred, scaled vectors on the first k components (sign
    fixed: the largest-|loading| entry of every component is positive)."""
    z, _ = _centred_scaled(df, features)
    return _project(z, PCA(k=k, inputCol="__z", outputCol="__pc").fit(z), k, out)


def _project(z: DataFrame, model, k: int, out: str) -> tuple[DataFrame, object]:
    """The first k components of a fitted PCA, signs fixed."""
    pcm = model.pc.toArray()
    signs = [1.0 if pcm[abs(pcm[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    res = model.transform(z).withColumn(out, array_to_vector(F.transform(
        F.slice(vector_to_array("__pc"), 1, k), lambda v, i: v * F.element_at(F.array(*[F.lit(s) for s in signs]), i + 1))))
    return res.drop("__z", "__pc"), model


def pca_variance(df: DataFrame, share: float = 0.95, features: str = "features", out: str = "pca"):
    """P-16: smallest k whose cumulative explained variance reaches ``share``; one fit
    of all components, cut at k."""
    z, model = _full_pca(df, features)
    scree = _scree_rows(model)
    k = next((c for c, _, cum in scree if cum >= share - 1e-12), len(scree))
    res, model = _project(z, model, k, out)
    return k, res, model


def pca_on_train(train: DataFrame, test: DataFrame, share: float = 0.95, features: str = "features"):
    """(k, train, test) with ``features`` replaced by the first k components that reach
    ``share``; scaler and components are fitted on the train rows only."""
    sc = StandardScaler(inputCol=features, outputCol="__z", withMean=True, withStd=True).fit(train)
    z = sc.transform(train)
    model = PCA(k=int(sc.mean.size), inputCol="__z", outputCol="__pc").fit(z)
    k = next((c for c, _, cum in _scree_rows(model) if cum >= share - 1e-12), int(sc.mean.size))
    cut = lambda d: d.drop(features).withColumn(
        features, array_to_vector(F.slice(vector_to_array("__pc"), 1, k))).drop("__z", "__pc")
    return k, cut(model.transform(z)), cut(model.transform(sc.transform(test)))


# ------------------------------------------------------------------- persist
def save_pipeline(model: PipelineModel, path: str) -> str:
    """Write a fitted pipeline to a folder that all executors reach."""
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
