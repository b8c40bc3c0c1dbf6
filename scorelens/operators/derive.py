"""Filters, projections, derived columns.

Column statistics needed by a row-wise transform (mean, std, min, max, sum)
are computed by one global aggregate, which yields exactly one row, and joined
back with a broadcast cross join: the broadcast side is one row by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.functions.exprs import band_expr, clip, nan_to_null


def filter_eq_in(df: DataFrame, eq: dict | None = None, isin: dict | None = None) -> DataFrame:
    """F-01: equality and IN-list masks combined with AND (pushed to the scan)."""
    cond = F.lit(True)
    for c, v in (eq or {}).items():
        cond = cond & (F.col(c) == F.lit(v))
    for c, vs in (isin or {}).items():
        cond = cond & F.col(c).isin(list(vs))
    return df.where(cond)


def exclude_columns(df: DataFrame, cols: list[str] | None = None, contains: str | None = None,
                    suffix: str | None = None) -> DataFrame:
    """F-02: drop a computed list of columns (explicit, by substring or by suffix)."""
    drop = set(cols or [])
    for c in df.columns:
        if (contains and contains in c) or (suffix and c.endswith(suffix)):
            drop.add(c)
    return df.drop(*sorted(drop))


def dropna_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """F-03: drop rows with any NULL (NaN counts as missing, N1)."""
    cols = subset or df.columns
    dtypes = dict(df.dtypes)
    cond = F.lit(True)
    for c in cols:
        x = F.col(c)
        cond = cond & x.isNotNull()
        if dtypes[c] in ("double", "float"):
            cond = cond & ~F.isnan(x)
    return df.where(cond)


def to_numeric_coerce(df: DataFrame, cols: list[str]) -> DataFrame:
    """F-04: bad text -> NULL instead of an error."""
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


def normalise_nan(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NaN -> NULL on floating columns (the canonical missing value, N1)."""
    dt = dict(df.dtypes)
    cols = cols or [c for c in df.columns if dt[c] in ("double", "float")]
    return df.select(*[nan_to_null(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def clip_range(df: DataFrame, cols: list[str], lo: float, hi: float) -> DataFrame:
    """F-05: clamp to [lo, hi]."""
    return df.select(*[clip(c, lo, hi).alias(c) if c in cols else F.col(c) for c in df.columns])


def row_mean_total(df: DataFrame, parts: list[str], out: str) -> DataFrame:
    """F-06: total = arithmetic mean of the part columns (NULL if a part is NULL)."""
    s = None
    for c in parts:
        s = F.col(c).cast("double") if s is None else s + F.col(c).cast("double")
    return df.withColumn(out, s / float(len(parts)))


def _stats_row(df: DataFrame, cols: list[str], fns: dict) -> DataFrame:
    return F.broadcast(df.agg(*[fn(F.col(c).cast("double")).alias(f"__{k}__{c}")
                                for c in cols for k, fn in fns.items()]))


def zscore_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """F-07: (x - mean) / sample std, column left unchanged when std is 0 or NULL."""
    st = _stats_row(df, cols, {"m": F.avg, "s": F.stddev_samp})
    j = df.crossJoin(st)
    out = []
    for c in df.columns:
        if c in cols:
            m, s = F.col(f"__m__{c}"), F.col(f"__s__{c}")
            out.append(F.when(s.isNull() | (s == 0), F.col(c).cast("double"))
                       .otherwise((F.col(c) - m) / s).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def minmax_columns(df: DataFrame, cols: list[str], eps: float = 1e-12) -> DataFrame:
    """F-08: (x - min) / (max - min + eps)."""
    st = _stats_row(df, cols, {"lo": F.min, "hi": F.max})
    j = df.crossJoin(st)
    return j.select(*[((F.col(c) - F.col(f"__lo__{c}")) / (F.col(f"__hi__{c}") - F.col(f"__lo__{c}") + eps)).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


def sum_normalize(df: DataFrame, col_: str, out: str | None = None, eps: float = 1e-12,
                  by: list[str] | None = None) -> DataFrame:
    """F-09: v / (sum v + eps), over the whole column or per group ``by``."""
    out = out or col_
    if by:
        tot = df.groupBy(*by).agg(F.sum(col_).alias("__tot"))
        j = df.join(tot, by)
    else:
        j = df.crossJoin(F.broadcast(df.agg(F.sum(col_).alias("__tot"))))
    return j.withColumn(out, F.col(col_) / (F.col("__tot") + eps)).drop("__tot")


def domain_prefix_tag(df: DataFrame, col_: str, mapping: dict[str, str], out: str = "domain",
                      prefix_out: str | None = None, default: str = "other") -> DataFrame:
    """F-10: longest prefix ``p`` with name == p or name starting with ``p_`` -> domain.

    The prefix map is a user parameter (a handful of entries), compiled into
    one CASE ordered by prefix length, so no join is needed.
    """
    items = sorted(mapping.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    c = F.col(col_)
    dom = None
    pre = None
    for p, d in items:
        cond = (c == p) | c.startswith(p + "_")
        dom = F.when(cond, F.lit(d)) if dom is None else dom.when(cond, F.lit(d))
        pre = F.when(cond, F.lit(p)) if pre is None else pre.when(cond, F.lit(p))
    res = df.withColumn(out, dom.otherwise(F.lit(default)) if dom is not None else F.lit(default))
    if prefix_out:
        res = res.withColumn(prefix_out, pre if pre is not None else F.lit(None).cast("string"))
    return res


def feature_label(df: DataFrame, col_: str, mapping: dict[str, str], out: str = "label") -> DataFrame:
    """F-11: "[domain] suffix" where suffix is the name without its matched prefix."""
    t = domain_prefix_tag(df, col_, mapping, out="__dom", prefix_out="__pre")
    c = F.col(col_)
    suffix = (F.when(F.col("__pre").isNull() | (c == F.col("__pre")), c)
              .otherwise(F.expr(f"substring(`{col_}`, length(__pre) + 2)")))
    return t.withColumn(out, F.concat(F.lit("["), F.col("__dom"), F.lit("] "), suffix)).drop("__dom", "__pre")


def feature_rule_tags(df: DataFrame, col_: str, rules: list[tuple[str, str]], out: str = "tags") -> DataFrame:
    """F-12: keyword rules -> array of reason tags (in rule order, no duplicates)."""
    c = F.lower(F.col(col_))
    arr = F.array(*[F.when(c.contains(k.lower()), F.lit(tag)) for k, tag in rules])
    return df.withColumn(out, F.array_distinct(F.filter(arr, lambda x: x.isNotNull())))


def feature_to_raw(df: DataFrame, col_: str, prefix: str = "num__", out: str = "raw") -> DataFrame:
    """F-13: ``num__x`` -> ``x``; anything else -> NULL."""
    c = F.col(col_)
    return df.withColumn(out, F.when(c.startswith(prefix), F.expr(f"substring(`{col_}`, {len(prefix) + 1})")))


def code_label_map(df: DataFrame, col_: str, mapping: dict[str, str], out: str = "label",
                   upper_fallback: bool = True) -> DataFrame:
    """F-14: code -> label; unknown codes fall back to the (upper-cased) code.

    The lookup is a small literal map; a broadcast left join is used so that a
    long code list stays a table, not a generated expression.
    """
    spark = df.sparkSession
    lut = spark.createDataFrame(list(mapping.items()), "code string, __label string")
    j = df.join(F.broadcast(lut), F.col(col_) == F.col("code"), "left")
    fb = F.upper(F.col(col_)) if upper_fallback else F.col(col_)
    return j.withColumn(out, F.coalesce(F.col("__label"), fb)).drop("code", "__label")


def band_by_threshold(df: DataFrame, col_: str, thresholds: list[tuple[float, str]], default: str,
                      op: str = ">", out: str = "band") -> DataFrame:
    """F-15: value -> band, thresholds checked in order."""
    return df.withColumn(out, band_expr(col_, thresholds, default, op))


def near_best_band(df: DataFrame, group: str, value: str, near: float = 0.01, close: float = 0.03,
                   relative: bool = True, higher_is_better: bool = True, out: str = "band") -> DataFrame:
    """F-16: per group: 'best', within ``near`` / ``close`` of the best (relative
    or absolute), else 'other'. Input is an aggregated score table."""
    w = Window.partitionBy(group)
    v = F.col(value)
    best = F.max(v).over(w) if higher_is_better else F.min(v).over(w)
    gap = (best - v) if higher_is_better else (v - best)
    lim_n = F.abs(best) * near if relative else F.lit(near)
    lim_c = F.abs(best) * close if relative else F.lit(close)
    return df.withColumn(out, F.when(gap == 0, "best").when(gap <= lim_n, "near")
                         .when(gap <= lim_c, "close").otherwise("other"))
