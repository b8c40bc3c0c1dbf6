"""Canonical views over the driver tables.

``W1``  order-line fact table: grade (1..5) is the target, region / part type /
        market segment are the segments, eight numeric columns are the scores.
``W1n`` W1 with zero discount / tax turned into NULL (missing-value operators).
``W2``  embeddings as a 64-wide numeric table with a label.
``W3``  events: type, user, value, day.
``P``   W1 plus a deterministic, integer-built prediction and class probabilities.
``RS``  a model x seed x condition x metric score cube, aggregated from P-like
        per-row predictions over W1 (its work grows with the fact table).

Every view is defined twice: as DataFrame code and as DuckDB SQL text with the
same semantics, so the independent check runs the same bindings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.session import ON_RELEASE, tables_root

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "p_retailprice", "p_size", "c_acctbal", "o_totalprice"]
SEGMENTS = ["area", "product", "client"]
TARGET = "grade"
CLASSES = [1, 2, 3, 4, 5]
N_MODELS = 5
EMB_DIM = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_key_sql(prefix: str = "") -> str:
    p = prefix
    parts = [f"cast({p}l_orderkey as string)", f"cast({p}l_linenumber as string)",
             f"cast({p}l_partkey as string)", f"cast({p}l_suppkey as string)",
             f"cast(cast({p}l_quantity as bigint) as string)",
             f"cast(cast(round({p}l_extendedprice * 100) as bigint) as string)"]
    return "concat_ws('|', " + ", ".join(parts) + ")"


W1_COLUMNS = ["row_key", "l_orderkey", "l_linenumber", "l_partkey", "grade", "year", *SEGMENTS, *FEATURES]
_MATERIALISED: dict[tuple, str] = {}
ON_RELEASE.append(_MATERIALISED.clear)


def _source_signature(spark: SparkSession, sf_dir: str, names: list[str]) -> str:
    """A hash of the source files' names, sizes and times, as Spark's own file listing
    has them (any file system); the contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load([f"{sf_dir}/{n}.parquet" for n in names]).select("path", "length", "modificationTime"))
    n, h = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return f"{n}-{(h or 0) & 0xFFFFFFFFFFFFFFFF:016x}"


def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-line fact view, built once per session and source version as a
    parquet table in the shared checkpoint folder (the ETL step a production
    deployment runs once); every query then scans it with column pruning
    instead of re-running the five-way join."""
    key = (spark.sparkContext.applicationId, sf_dir,
           _source_signature(spark, sf_dir, ["lineitem", "orders", "customer", "nation", "region", "part"]))
    path = _MATERIALISED.get(key)
    if path is None:
        path = f"{tables_root(spark)}/view-w1-{key[2]}"
        from scorelens.plans.helpers import shuffles_go
        with shuffles_go(spark):
            w1_join(spark, sf_dir).write.mode("overwrite").parquet(path)
        _MATERIALISED[key] = path
    return spark.read.parquet(path)


def w1_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 as a plan over the raw tables (no materialisation). Orders meet their customers
    before the lines meet their orders, so that lines are shuffled once with their own
    columns only, then by part where that table is not small; two tiny tables add names at
    the end. Lines and orders are merged at every size: both grow with the input."""
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax")
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"),
        F.expr("cast(substr(o_orderpriority, 1, 1) as int)").alias("grade"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.col("c_mktsegment").alias("client"))
    # nation (25 rows) and region (5 rows) are bounded by the TPC-H schema itself.
    n = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    r = F.broadcast(read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("area")))
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("product"),
                                           F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    oc = o.join(c, o.o_custkey == c.c_custkey).drop("o_custkey", "c_custkey")
    df = (li.join(oc.hint("merge"), li.l_orderkey == oc.o_orderkey).drop("o_orderkey")
            .join(p, F.col("l_partkey") == p.p_partkey).drop("p_partkey")
            .join(n, F.col("c_nationkey") == n.n_nationkey)
            .join(r, F.col("n_regionkey") == r.r_regionkey))
    return df.withColumn("row_key", F.expr(_row_key_sql())).select(*W1_COLUMNS)


W1_SQL = f"""
SELECT {_row_key_sql()} AS row_key, l_orderkey, l_linenumber, l_partkey,
       cast(substr(o_orderpriority, 1, 1) AS int) AS grade,
       cast(year(o_orderdate) AS int) AS year, r_name AS area, p_type AS product, c_mktsegment AS client,
       l_quantity, l_extendedprice, l_discount, l_tax, p_retailprice,
       cast(p_size AS double) AS p_size, c_acctbal, o_totalprice
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey
"""


def w1n(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w1(spark, sf_dir)
    return (df.withColumn("l_discount", F.expr("nullif(l_discount, 0.0D)"))
              .withColumn("l_tax", F.expr("nullif(l_tax, 0.0D)")))


W1N_SQL = f"""
SELECT * REPLACE (nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax)
FROM ({W1_SQL}) w1_base
"""


def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(EMB_DIM)]
    return e.select("vec_id", F.col("label").cast("int").alias("label"), *cols)


W2_SQL = ("SELECT vec_id, cast(label AS int) AS label, "
          + ", ".join(f"cast(embedding[{i + 1}] AS double) AS e{i}" for i in range(EMB_DIM))
          + " FROM embeddings")


def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    return ev.select("event_id", "user_id", "event_type", "value",
                     F.to_date("ts").alias("day"), "ts")


W3_SQL = "SELECT event_id, user_id, event_type, value, cast(ts AS date) AS day, ts FROM events"


# --------------------------------------------------------------------- P view
# Integer-built class weights: a noisy score per class, with a boost on the
# true grade so the "model" is informative but not perfect.
def _weight_sql(k: int) -> str:
    return (f"(1 + ((l_orderkey * {k + 2} + l_linenumber * {2 * k + 1} + l_partkey) % 7)"
            f" + CASE WHEN grade = {k} THEN 3 ELSE 0 END)")


def _argmax_sql(names: list[str]) -> str:
    whens = []
    for i, a in enumerate(names):
        conds = [f"{a} > {b}" for b in names[:i]] + [f"{a} >= {b}" for b in names[i + 1:]]
        whens.append(f"WHEN {' AND '.join(conds) or 'TRUE'} THEN {i + 1}")
    return "(CASE " + " ".join(whens) + " END)"


P_WEIGHTS = {f"w{k}": _weight_sql(k) for k in CLASSES}
P_PRED_SQL = _argmax_sql([f"w{k}" for k in CLASSES])
P_PROB_SQL = {f"prob_{k}": f"(w{k} * 1e0 / (w1 + w2 + w3 + w4 + w5))" for k in CLASSES}


def p_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same semantics as ``P_SQL``; the argmax is written with array functions
    (first maximum = lowest class on ties, like the CASE chain) so that each
    class weight is evaluated once even after the optimizer inlines it into
    pushed-down filters."""
    df = w1(spark, sf_dir)
    w = F.array(*[F.expr(e) for e in P_WEIGHTS.values()])
    df = df.withColumn("__w", w)
    df = df.withColumn("pred", F.array_position("__w", F.array_max("__w")).cast("int"))
    tot = F.aggregate("__w", F.lit(0).cast("long"), lambda a, b: a + b)
    df = df.withColumn("__t", tot)
    for i, k in enumerate(CLASSES):
        df = df.withColumn(f"prob_{k}", F.col("__w")[i].cast("double") / F.col("__t"))
    return df.drop("__w", "__t").withColumnRenamed("grade", "label")


P_SQL = f"""
SELECT * EXCLUDE (w1, w2, w3, w4, w5, grade), grade AS label FROM (
  SELECT *, {P_PRED_SQL} AS pred,
         {', '.join(f'{e} AS {n_}' for n_, e in P_PROB_SQL.items())}
  FROM (SELECT *, {', '.join(f'{e} AS {n_}' for n_, e in P_WEIGHTS.items())}
        FROM ({W1_SQL}) w1_base) pw
) pv
"""


# -------------------------------------------------------------------- RS view
def _model_pred_sql(m: int) -> str:
    """Model m is right on about (3 + m)/10 of the rows, else a fixed wrong-ish grade."""
    return (f"(CASE WHEN ((l_orderkey * {m + 3} + l_partkey * {m} + l_linenumber) % 10) < {m + 3} "
            f"THEN grade ELSE 1 + ((l_orderkey + {m}) % 5) END)")


RS_METRICS = ["accuracy", "mae"]


def rs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score cube (seed = order year block, condition = unweighted / class-weighted)."""
    df = w1(spark, sf_dir).select("grade", "year", "l_orderkey", "l_partkey", "l_linenumber")
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in range(1, N_MODELS + 1):
        pm = F.expr(_model_pred_sql(m))
        aggs.append(F.sum(F.when(pm == F.col("grade"), 1).otherwise(0)).alias(f"hit{m}"))
        aggs.append(F.sum(F.abs(pm - F.col("grade"))).alias(f"err{m}"))
    per_class = df.groupBy(F.col("year").alias("seed"), "grade").agg(*aggs)
    rows = []
    for m in range(1, N_MODELS + 1):
        for cond, acc, mae in (
            ("unweighted", F.sum(f"hit{m}") / F.sum("n"), F.sum(f"err{m}") / F.sum("n")),
            ("weighted", F.avg(F.col(f"hit{m}") / F.col("n")), F.avg(F.col(f"err{m}") / F.col("n"))),
        ):
            rows.append(F.struct(F.lit(cond).alias("condition"), F.lit(f"m{m}").alias("model"),
                                 F.lit("accuracy").alias("metric"), acc.cast("double").alias("value")))
            rows.append(F.struct(F.lit(cond).alias("condition"), F.lit(f"m{m}").alias("model"),
                                 F.lit("mae").alias("metric"), mae.cast("double").alias("value")))
    # one small row per seed, unpacked into the long cube without a second scan;
    # the cube (seeds x 20 rows) is materialised once because every test on it
    # reads it from several branches
    from scorelens.plans.helpers import checkpoint
    return checkpoint(per_class.groupBy("seed").agg(F.array(*rows).alias("r"))
                      .select(F.col("seed").cast("int").alias("seed"), F.inline("r")))


def _rs_sql() -> str:
    hits = ", ".join(
        f"sum(CASE WHEN {_model_pred_sql(m)} = grade THEN 1 ELSE 0 END) AS hit{m}, "
        f"sum(abs({_model_pred_sql(m)} - grade)) AS err{m}" for m in range(1, N_MODELS + 1))
    parts = []
    for m in range(1, N_MODELS + 1):
        parts.append(f"SELECT seed, 'unweighted' AS condition, 'm{m}' AS model, 'accuracy' AS metric, "
                     f"sum(hit{m}) * 1e0 / sum(n) AS value FROM pc GROUP BY seed")
        parts.append(f"SELECT seed, 'unweighted', 'm{m}', 'mae', sum(err{m}) * 1e0 / sum(n) FROM pc GROUP BY seed")
        parts.append(f"SELECT seed, 'weighted', 'm{m}', 'accuracy', avg(hit{m} * 1e0 / n) FROM pc GROUP BY seed")
        parts.append(f"SELECT seed, 'weighted', 'm{m}', 'mae', avg(err{m} * 1e0 / n) FROM pc GROUP BY seed")
    return (f"SELECT cast(seed AS int) AS seed, condition, model, metric, value FROM ("
            f"WITH pc AS (SELECT year AS seed, grade, count(*) AS n, {hits} "
            f"FROM ({W1_SQL}) w1_base GROUP BY year, grade) "
            + " UNION ALL ".join(parts) + ") rs_u")


RS_SQL = _rs_sql()
