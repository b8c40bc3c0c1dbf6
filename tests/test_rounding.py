"""The rounding at the checking boundary: the SQL text's numbers, each power computed once."""

import math
import struct

from pyspark.sql import functions as F

from scorelens.functions import exprs as E

VALUES = [None, 0.0, -0.0, 1.0, -1.0, 1e-300, 5e-324, 1e-12, 4.9e-13, 123456789.5, 0.1 + 0.2, 1e9, 999999999.5, 1e15 / 7, -1e22 / 3, 1e30 / 7,
          1e300, 1.7e308, float("nan"), float("inf"), float("-inf")]
VALUES += [s * m * 10.0 ** k for k in range(-20, 31) for m in (0.9999999999999999, 1.0, 1.0000000000000002, 3.0000000005, 7 / 3) for s in (1, -1)]


def bits(v):
    return None if v is None else "nan" if math.isnan(v) else struct.pack("<d", v)


def test_same_bits_as_the_sql_text(spark):
    df = spark.createDataFrame([(i, v, None if v is None else float(v) / 3) for i, v in enumerate(VALUES)], "id long, `a.b` double, f double") \
              .withColumn("f", F.col("f").cast("float"))
    want = df.select("id", *[F.expr(E.round_sig_sql(f"`{c}`")).cast("double").alias(c) for c in ("a.b", "f")]).orderBy("id").collect()
    out = E.round_sig_columns(df, ["a.b", "f"])
    got = out.orderBy("id").collect()
    assert out.columns == df.columns
    assert [(r[0], bits(r[1]), bits(r[2])) for r in got] == [(r[0], bits(r[1]), bits(r[2])) for r in want]


def test_a_logarithm_a_number(spark):
    plan = E.round_sig_columns(spark.range(3).selectExpr("id / 7 AS x"), ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("log10(") == 1 and plan.lower().count("pow(") <= 1
