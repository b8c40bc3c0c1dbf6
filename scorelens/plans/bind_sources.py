"""Bindings for §2.1 (sources, sinks, schema, generators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.operators import agg
from scorelens.sources import io, synth
from scorelens.plans import views as V
from scorelens.plans.registry import register

W1 = f"({V.W1_SQL}) w1"
# class shares of the reference survey's target (fixed values): 520, 430, 260, 180, 110 of 1,500
SURVEY_CLASS_PROBS = [520 / 1500, 430 / 1500, 260 / 1500, 180 / 1500, 110 / 1500]


@register("read_table", dbl=["l_quantity"], sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def q_read_table(spark, sf):
    return io.read_table(spark, f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")


@register("train_test_load", sql="""
SELECT o_orderkey, 'o_orderpriority' AS target, CASE WHEN year(o_orderdate) < 1999 THEN 'train' ELSE 'test' END AS split
FROM orders
""")
def q_train_test_load(spark, sf):
    manifest = {"target": "o_orderpriority",
                "train": {"path": f"{sf}/orders.parquet", "where": "year(o_orderdate) < 1999"},
                "test": {"path": f"{sf}/orders.parquet", "where": "year(o_orderdate) >= 1999"}}
    target, df = io.train_test_load(spark, manifest)
    return df.select("o_orderkey", F.lit(target).alias("target"), "split")


@register("write_csv_result", dbl=["mean_target", "mean_group"], sql=" UNION ALL ".join(
    f"SELECT '{s}' AS segment, cast({s} AS varchar) AS level, count(*) AS n, avg(grade) AS mean_target, "
    f"avg(l_extendedprice) AS mean_group FROM {W1} GROUP BY {s}" for s in V.SEGMENTS))
def q_write_csv(spark, sf):
    kpi = agg.segment_kpi(V.w1(spark, sf), V.SEGMENTS, "grade", ["l_extendedprice"])
    path = io.write_csv_result(kpi, io.output_root(spark, "csv"))
    return io.read_table(spark, path, fmt="csv", schema=kpi.schema)


# the index without its paths, which are new ones in every run
@register("write_multi_result", sql=f"""
SELECT 'class_distribution' AS name, count(DISTINCT grade) AS rows FROM {W1} WHERE grade IS NOT NULL
UNION ALL SELECT 'segment_kpi', {" + ".join(f"(SELECT count(*) FROM (SELECT DISTINCT {s} FROM {W1}) d)" for s in V.SEGMENTS)}
UNION ALL SELECT 'class_profile', count(*) FROM (SELECT DISTINCT grade FROM {W1}) g
""")
def q_write_multi(spark, sf):
    w = V.w1(spark, sf)
    tables = {"class_distribution": agg.class_distribution(w, "grade"),
              "segment_kpi": agg.segment_kpi(w, V.SEGMENTS, "grade", ["l_extendedprice"]),
              "class_profile": agg.class_profile(w, "grade", V.FEATURES)}
    return io.write_multi_result(tables, io.output_root(spark, "multi")).select("name", "rows")


@register("json_payload", sql=f"""
SELECT to_json({{'grade': grade, 'n': n}}) AS payload FROM (SELECT grade, count(*) AS n FROM {W1} GROUP BY grade) c
""")
def q_json_payload(spark, sf):
    c = V.w1(spark, sf).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))
    return io.json_payload(c)


_TYPE_MAP = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' " \
            "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"


@register("schema_report", sql=f"""
SELECT cast(ordinal_position - 1 AS int) AS position, column_name AS "column", {_TYPE_MAP} AS dtype
FROM information_schema.columns WHERE table_name = 'orders'
""")
def q_schema_report(spark, sf):
    return io.schema_report(V.read(spark, sf, "orders"))


_ROLE_COLS = [("row_key", "string"), ("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_partkey", "bigint"),
              ("grade", "int"), ("year", "int"), ("area", "string"), ("product", "string"), ("client", "string")] + \
             [(c, "double") for c in V.FEATURES]


def _role_sql(c, t):
    if t in ("int", "bigint"):
        return (f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CASE WHEN count(DISTINCT {c}) <= 20 THEN 'categorical' "
                f"ELSE 'numeric' END AS role FROM {W1}")
    role = "numeric" if t == "double" else "categorical"
    return f"SELECT '{c}' AS \"column\", '{t}' AS dtype, '{role}' AS role"


@register("detect_column_roles", sql=" UNION ALL ".join(_role_sql(c, t) for c, t in _ROLE_COLS))
def q_detect_roles(spark, sf):
    return io.detect_column_roles(V.w1(spark, sf))


@register("column_group", dbl=["l_extendedprice", "p_retailprice", "o_totalprice"],
          sql=f"SELECT row_key, l_extendedprice, p_retailprice, o_totalprice FROM {W1}")
def q_column_group(spark, sf):
    return io.column_group(V.w1(spark, sf), contains="price", keep=["row_key"])


@register("require_columns", sql=f"SELECT row_key, grade, area FROM {W1}")
def q_require_columns(spark, sf):
    return io.require_columns(V.w1(spark, sf), ["grade", "area"]).select("row_key", "grade", "area")


@register("union_splits", dbl=["acctbal"], sql="""
SELECT c_custkey AS id, c_acctbal AS acctbal, c_mktsegment, 'customer' AS source FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier' FROM supplier
""")
def q_union_splits(spark, sf):
    c = V.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"),
                                             "c_mktsegment", F.lit("customer").alias("source"))
    s = V.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"),
                                             F.lit("supplier").alias("source"))
    return io.union_splits(c, s)


@register("preview_head", dbl=["o_totalprice"], sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5
""")
def q_preview_head(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return io.preview_head(o, 5, ["o_orderkey"])


@register("synth_survey_balanced")
def q_synth_balanced(spark, sf):
    keys = V.read(spark, sf, "orders").select("o_orderkey", F.expr("cast(substr(o_orderpriority, 1, 1) as int)").alias("g"))
    return synth.synth_survey_balanced(keys, "o_orderkey", class_col="g")


@register("synth_survey_latent")
def q_synth_latent(spark, sf):
    keys = V.read(spark, sf, "orders").select("o_orderkey")
    return synth.synth_survey_latent(keys, "o_orderkey", SURVEY_CLASS_PROBS)
