"""Registry of checked queries: a Spark query over the driver tables and the
independent DuckDB SQL for the same result.

Floating columns are compared after rounding to 9 significant digits with an
expression that is bit-identical in both engines (``round_sig_sql``); the
operators themselves return full precision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from scorelens.functions.exprs import round_sig_columns, round_sig_sql
from scorelens.session import ship_package


@dataclass
class Binding:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    dbl: list[str] = field(default_factory=list)


REGISTRY: dict[str, Binding] = {}


def register(name: str, sql: str | None = None, dbl: list[str] | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Binding(name, fn, sql, list(dbl or []))
        return fn
    return deco


def rounded(df: DataFrame) -> DataFrame:
    return round_sig_columns(df, [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))])


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    b = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return rounded(b.fn(spark, sf_dir))
    return run


def oracle(name: str) -> str | None:
    b = REGISTRY[name]
    if b.sql is None:
        return None
    if not b.dbl:
        return b.sql
    repl = ", ".join(f"cast({round_sig_sql(c)} AS double) AS {c}" for c in b.dbl)
    return f"SELECT * REPLACE ({repl}) FROM ({b.sql}) oracle_q"
