"""Sources, sinks and schema helpers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.operators.derive import normalise_nan
from scorelens.session import tables_root


def read_table(spark: SparkSession, path: str, fmt: str | None = None, header: bool = True,
               infer_schema: bool = True, schema=None) -> DataFrame:
    """S-01: load by suffix: .csv / .tsv / .txt (tab) / .json / .orc / .parquet
    (directories default to parquet). CSV is read with a UTF-8 BOM-aware header.
    NaN becomes NULL, the one missing value (N1)."""
    p = path.lower()
    fmt = fmt or ("csv" if p.endswith(".csv") else "tsv" if p.endswith((".tsv", ".txt")) else
                  "json" if p.endswith((".json", ".jsonl")) else "orc" if p.endswith(".orc") else "parquet")
    if fmt in ("csv", "tsv"):
        r = spark.read.option("header", header).option("encoding", "UTF-8").option("sep", "," if fmt == "csv" else "\t")
        r = r.schema(schema) if schema is not None else r.option("inferSchema", infer_schema)
        df = r.csv(path)
        # strip a BOM that some writers put in front of the first header name
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    elif fmt == "json":
        df = spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)
    elif fmt == "orc":
        df = spark.read.orc(path)
    else:
        df = spark.read.parquet(path)
    return normalise_nan(df)


def train_test_load(spark: SparkSession, manifest: dict | str, split_col: str = "split") -> tuple[str, DataFrame]:
    """S-02: a manifest names the target and the train / test sources:
    ``{"target": ..., "train": path | {"path", "where"}, "test": ...}`` (a dict
    or a JSON file). Returns (target, one frame with a ``split`` column)."""
    if isinstance(manifest, str):
        manifest = json.loads("".join(r.value for r in spark.read.text(manifest).collect()))
    parts = []
    for name in ("train", "test"):
        spec = manifest[name]
        spec = {"path": spec} if isinstance(spec, str) else spec
        df = read_table(spark, spec["path"])
        if spec.get("where"):
            df = df.where(spec["where"])
        parts.append(df.withColumn(split_col, F.lit(name)))
    return manifest["target"], union_splits(parts[0], parts[1])


def union_splits(a: DataFrame, b: DataFrame) -> DataFrame:
    """S-10: stack two splits by column name (missing columns become NULL)."""
    return a.unionByName(b, allowMissingColumns=True)


def output_root(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location."""
    return "/".join([tables_root(spark), "out", *parts, uuid.uuid4().hex])


def write_csv_result(df: DataFrame, path: str, single_file: bool = False) -> str:
    """S-03: CSV with header (UTF-8). Partitioned output by default; a single
    file only when asked (it funnels the data through one task)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def write_multi_result(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> DataFrame:
    """S-04: several named result tables under one root, one folder each;
    returns an index (name, path, rows) read back from the written data."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        p = f"{root.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(p)
        rows.append((name, p))
    idx = None
    for name, p in rows:
        c = spark.read.format(fmt).load(p).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"), F.lit(p).alias("path"), "rows")
        idx = c if idx is None else idx.unionByName(c)
    return idx


def json_payload(df: DataFrame, out: str = "payload") -> DataFrame:
    """S-05: every row of a (small, aggregated) KPI frame as one JSON object."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(out))


def schema_report(df: DataFrame) -> DataFrame:
    """S-06: column name -> Spark SQL type name, in column order."""
    spark = df.sparkSession
    return spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "position int, column string, dtype string")


_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
_INTEGER = ("tinyint", "smallint", "int", "bigint")


def detect_column_roles(df: DataFrame, max_unique: int = 20) -> DataFrame:
    """S-07: datetime / numeric / categorical. An integer column with at most
    ``max_unique`` distinct values is categorical. One aggregate over the
    integer columns (distinct counts capped at max_unique + 1 is not needed:
    ``approx`` would misclassify near the boundary, so counts are exact)."""
    dt = df.dtypes
    ints = [c for c, t in dt if t in _INTEGER]
    counts = {}
    if ints:
        row = df.agg(*[F.count_distinct(c).alias(c) for c in ints]).collect()[0]
        counts = {c: row[c] for c in ints}
    out = []
    for c, t in dt:
        if t.startswith("timestamp") or t == "date":
            role = "datetime"
        elif t in _NUMERIC:
            role = "categorical" if (t in _INTEGER and counts[c] <= max_unique) else "numeric"
        else:
            role = "categorical"
        out.append((c, t, role))
    return df.sparkSession.createDataFrame(out, "column string, dtype string, role string")


def column_group(df: DataFrame, contains: str | None = None, prefix: str | None = None,
                 suffix: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """S-08: select the columns whose name matches the pattern."""
    cols = [c for c in df.columns
            if (contains is None or contains in c) and (prefix is None or c.startswith(prefix))
            and (suffix is None or c.endswith(suffix))]
    return df.select(*(keep or []), *cols)


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """S-09: raise when a listed column is missing; otherwise return ``df``."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def preview_head(df: DataFrame, k: int = 5, order: list[str] | None = None) -> DataFrame:
    """S-11: the first k rows in a stated order (top-k, not a full sort)."""
    return (df.orderBy(*order) if order else df).limit(k)
