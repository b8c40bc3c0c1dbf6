"""Profiling and data quality.

Per-column statistics run on the long form ``(feature, value)`` with one
``groupBy(feature)``: partial aggregation keeps the shuffle at
features x partitions rows. Exact quantiles (linear interpolation like
pandas) are selected in two aggregations; ``approx=True`` returns the sketch's.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.plans.helpers import to_long
from scorelens.plans.rank import quantile_arrays


def quantile_table(d: DataFrame, groups: list[str], value: str, ps: list[float], approx: bool = False) -> DataFrame:
    """(groups..., ``_q`` array of the quantiles in ``ps`` order).

    Exact by default by distributed selection (no group is held in one task, no
    row sorted); ``approx=True`` uses ``percentile_approx`` sketches."""
    d = d.where(F.col(value).isNotNull())
    if approx:
        g = d.groupBy(*groups) if groups else d.groupBy()
        return g.agg(F.percentile_approx(F.col(value), ps, 10000).alias("_q"))
    return quantile_arrays(d, groups, value, ps)


def profile_columns(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Q-01: mean, sample std, min, p25, median, p75, max, null % per column."""
    long = to_long(df, cols)
    v = F.col("value")
    s = long.groupBy("feature").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        (F.sum(F.when(v.isNull(), 1).otherwise(0)) * 100.0 / F.count(F.lit(1))).alias("null_pct"))
    s = s.join(quantile_table(long, ["feature"], "value", [0.25, 0.5, 0.75], approx), "feature", "left")
    return s.select("feature", "count", "mean", "std", "min", F.col("_q")[0].alias("p25"),
                    F.col("_q")[1].alias("median"), F.col("_q")[2].alias("p75"), "max", "null_pct")


def missing_summary(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Q-02: per column: null count, null % and type, sorted by null count desc.

    One aggregate row (a counter per column), then unpivot: no data blow-up."""
    dt = dict(df.dtypes)
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(F.when(F.col(c).isNull() | (F.isnan(F.col(c)) if dt[c] in ("double", "float") else F.lit(False)),
                                1).otherwise(0)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    pct = lambda i: F.col(f"m{i}") * 100.0 / F.col("__n")
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").cast("long").alias("null_count"),
                        (F.round(pct(i), digits) if digits is not None else pct(i)).alias("null_pct"),
                        F.lit(dt[c]).alias("dtype")) for i, c in enumerate(df.columns)]
    return row.select(F.inline(F.array(*structs))).orderBy(F.col("null_count").desc(), "column")


def null_cell_count(df: DataFrame) -> DataFrame:
    """Q-03: total number of NULL cells."""
    m = missing_summary(df)
    return m.agg(F.sum("null_count").cast("long").alias("null_cells"))


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Q-04: rows equal to an earlier row = sum(count - 1) over identical rows.
    Map-side partial aggregation collapses a hot duplicate before the shuffle."""
    cols = cols or df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__dup_n"))
    return g.agg(F.coalesce(F.sum(F.col("__dup_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
                 F.count(F.lit(1)).alias("distinct_rows"))


def constant_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Q-05: columns with at most one distinct non-null value (min = max test,
    one pass, no distinct aggregation)."""
    cols = cols or df.columns
    row = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("column"),
                        (F.col(f"lo{i}").isNull() | (F.col(f"lo{i}") == F.col(f"hi{i}"))).alias("is_constant"))
               for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*structs)))


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Q-06: number of distinct non-null values per column."""
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    row = df.agg(*[fn(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct"))
                                         for i, c in enumerate(cols)])))


def value_range_topk(df: DataFrame, cols: list[str], k: int = 20) -> DataFrame:
    """Q-07: max - min per column, the k widest."""
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(cols)])
    long = row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.col(f"hi{i}") - F.col(f"lo{i}")).alias("value_range"))
        for i, c in enumerate(cols)])))
    return long.orderBy(F.col("value_range").desc(), "feature").limit(k)


def range_check(df: DataFrame, cols: list[str], lo: float, hi: float) -> DataFrame:
    """Q-08: observed min / max of a column group against allowed bounds."""
    mins = [F.min(F.col(c).cast("double")) for c in cols]
    maxs = [F.max(F.col(c).cast("double")) for c in cols]
    row = df.agg(F.least(*mins).alias("observed_min") if len(cols) > 1 else mins[0].alias("observed_min"),
                 F.greatest(*maxs).alias("observed_max") if len(cols) > 1 else maxs[0].alias("observed_max"))
    return row.select("observed_min", "observed_max", F.lit(float(lo)).alias("lower"), F.lit(float(hi)).alias("upper"),
                      ((F.col("observed_min") >= lo) & (F.col("observed_max") <= hi)).alias("within_bounds"))


def class_imbalance(df: DataFrame, target: str, severe: float = 10.0, moderate: float = 3.0) -> DataFrame:
    """Q-09: largest / smallest class count and a verdict."""
    c = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    s = c.agg(F.max("n").alias("max_count"), F.min("n").alias("min_count"), F.count(F.lit(1)).alias("n_classes"))
    ratio = F.try_divide(F.col("max_count").cast("double"), F.col("min_count").cast("double"))
    return s.select("n_classes", "max_count", "min_count", ratio.alias("ratio"),
                    F.when(ratio > severe, "severe").when(ratio > moderate, "moderate").otherwise("balanced")
                    .alias("verdict"))


def column_shape_stats(df: DataFrame, cols: list[str], approx: bool = False, min_n: int = 5) -> DataFrame:
    """Q-10: missing rate, CV, IQR, outlier rate (Tukey fences) and unbiased skew.

    Pass 1: moments + quartiles per column; pass 2: the per-column fences
    (one row per column, broadcast) against the rows to count outliers."""
    long = to_long(df, cols)
    v = F.col("value")
    s1 = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_all"), F.count(v).alias("n"), F.avg(v).alias("mu"),
        F.stddev_samp(v).alias("sd"), F.skewness(v).alias("g1"))
    s1 = s1.join(quantile_table(long, ["feature"], "value", [0.25, 0.75], approx), "feature", "left")
    iqr = F.when(F.col("_q")[1] > F.col("_q")[0], F.col("_q")[1] - F.col("_q")[0]).otherwise(F.col("sd") + 1e-9)
    b = s1.select("feature", "n_all", "n", "mu", "sd", "g1", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"),
                  iqr.alias("iqr"))
    b = b.withColumn("lo", F.col("q1") - 1.5 * F.col("iqr")).withColumn("hi", F.col("q3") + 1.5 * F.col("iqr"))
    fences = F.broadcast(b.select("feature", "lo", "hi"))       # one row per column
    out_cnt = (long.where(v.isNotNull()).join(fences, "feature")
                   .groupBy("feature").agg(F.sum(F.when((v < F.col("lo")) | (v > F.col("hi")), 1).otherwise(0))
                                           .alias("n_out")))
    j = b.join(out_cnt, "feature", "left")
    n = F.col("n").cast("double")
    ok = F.col("n") >= min_n
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    return j.select("feature",
                    (F.col("n_all") - F.col("n")).cast("double").alias("_m"), "n_all", "n", "sd", "mu", "iqr", "n_out",
                    skew.alias("_skew")).select(
        "feature",
        (F.col("_m") / F.col("n_all")).alias("missing_rate"),
        F.when(ok, (F.col("sd") + 1e-9) / (F.abs("mu") + 1e-6)).alias("cv"),
        F.when(ok, F.col("iqr")).alias("iqr"),
        F.when(ok, F.col("n_out") / n).alias("outlier_rate"),
        F.when(ok, F.col("_skew")).alias("skew"))


def axis_bounds(df: DataFrame, cols: list[str], margin: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Q-11: [lo - m * span, hi + m * span] over a column group; span 1 if flat."""
    by = by or []
    g = df.groupBy(*by) if by else df.groupBy()
    mins = [F.min(F.col(c).cast("double")) for c in cols]
    maxs = [F.max(F.col(c).cast("double")) for c in cols]
    s = g.agg((F.least(*mins) if len(cols) > 1 else mins[0]).alias("lo"),
              (F.greatest(*maxs) if len(cols) > 1 else maxs[0]).alias("hi"))
    span = F.when(F.col("hi") != F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return s.select(*by, (F.col("lo") - span * margin).alias("axis_min"), (F.col("hi") + span * margin).alias("axis_max"))


def histogram_by_class(df: DataFrame, cols: list[str], bins: int = 20, class_col: str | None = None) -> DataFrame:
    """Q-12: fixed-width bins per column from a broadcast min / max row, counts
    per (column, class, bin) with the bin edges."""
    ids = [class_col] if class_col else []
    long = to_long(df, cols, ids).where(F.col("value").isNotNull())
    mm = F.broadcast(long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    b = long.join(mm, "feature").select(
        "feature", *ids, "lo", width.alias("width"),
        F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    h = b.groupBy("feature", *ids, "bin").agg(F.count(F.lit(1)).alias("count"),
                                             F.first("lo").alias("lo"), F.first("width").alias("width"))
    return h.select("feature", *ids, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"), "count")


def box_stats_by_class(df: DataFrame, value: str, class_col: str, approx: bool = False) -> DataFrame:
    """Q-13: quartiles, whiskers (furthest points inside the Tukey fences) and
    outlier count per class."""
    v = F.col(value).cast("double")
    d = df.where(v.isNotNull() & F.col(class_col).isNotNull()).select(class_col, v.alias("v"))
    q = d.groupBy(class_col).agg(F.count(F.lit(1)).alias("n")).join(
        quantile_table(d, [class_col], "v", [0.25, 0.5, 0.75], approx), class_col)
    q = q.select(class_col, "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    f = F.broadcast(q.select(class_col, (F.col("q1") - 1.5 * F.col("iqr")).alias("flo"),
                             (F.col("q3") + 1.5 * F.col("iqr")).alias("fhi")))   # one row per class
    inside = (F.col("v") >= F.col("flo")) & (F.col("v") <= F.col("fhi"))
    w = d.join(f, class_col).groupBy(class_col).agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_lo"), F.max(F.when(inside, F.col("v"))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(1)).alias("n_outliers"))
    return q.join(w, class_col).select(class_col, "n", "q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi",
                                       F.col("n_outliers").cast("long").alias("n_outliers"))


def kde_density(df: DataFrame, value: str, class_col: str | None = None, grid: int = 50,
                fine_bins: int = 512) -> DataFrame:
    """Q-14: binned Gaussian KDE on a grid (Scott bandwidth, sample std).

    The data are reduced to ``fine_bins`` bin counts per class first; each
    bin then contributes to the ``grid`` points (work = grid x bins, both
    parameters, independent of the row count)."""
    ids = [class_col] if class_col else []
    v = F.col(value).cast("double")
    d = df.where(v.isNotNull()).select(*ids, v.alias("v"))
    st = d.groupBy(*ids).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"),
                             F.count(F.lit(1)).alias("n"))
    bw = F.col("sd") * F.pow(F.col("n").cast("double"), -0.2)
    st = st.withColumn("h", bw).withColumn(
        "bw", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / fine_bins).otherwise(1.0))
    stb = F.broadcast(st)                                        # one row per class
    joined = d.join(stb, ids) if ids else d.crossJoin(stb)
    hist = (joined.select(*ids, F.least(F.floor((F.col("v") - F.col("lo")) / F.col("bw")), F.lit(fine_bins - 1))
                          .cast("int").alias("b"))
                  .groupBy(*ids, "b").agg(F.count(F.lit(1)).alias("c")))
    hj = hist.join(stb, ids) if ids else hist.crossJoin(stb)
    center = F.col("lo") + (F.col("b") + 0.5) * F.col("bw")
    step = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / (grid - 1)).otherwise(0.0)
    pts = hj.select(*ids, "c", "n", "h", center.alias("center"),
                    F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"), F.col("lo").alias("glo"),
                    step.alias("step"))
    x = F.col("glo") + F.col("g") * F.col("step")
    z = F.try_divide(x - F.col("center"), F.col("h"))
    contrib = F.try_divide(F.col("c") * F.exp(-0.5 * z * z), F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return (pts.groupBy(*ids, "g").agg(F.first(x).alias("x"), F.sum(contrib).alias("density"))
               .orderBy(*ids, "g"))

