"""Checked bindings for §2.2 (filters, projections, derived columns)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.operators import derive, stats
from scorelens.plans import views as V
from scorelens.plans.registry import register

W1 = f"({V.W1_SQL}) w1"
W1N = f"({V.W1N_SQL}) w1n"
RS = f"({V.RS_SQL}) rs"
FE = V.FEATURES
DOMAIN_MAP = {"l": "lineitem", "o": "orders", "c": "customer", "p": "part", "p_retail": "pricing"}
RULES = [("price", "price"), ("tax", "levy"), ("quantity", "volume"), ("acct", "account")]
AREA_LABELS = {"ASIA": "Asia-Pacific", "EUROPE": "Europe", "AMERICA": "Americas"}


@register("filter_eq_in", dbl=["l_quantity"], sql=f"""
SELECT row_key, area, product, l_quantity FROM {W1} WHERE area = 'ASIA' AND product IN ('SMALL', 'LARGE')
""")
def q_filter(spark, sf):
    d = derive.filter_eq_in(V.w1(spark, sf), eq={"area": "ASIA"}, isin={"product": ["SMALL", "LARGE"]})
    return d.select("row_key", "area", "product", "l_quantity")


@register("exclude_columns", dbl=["l_quantity", "l_discount", "l_tax", "p_size", "c_acctbal"], sql=f"""
SELECT * EXCLUDE (l_extendedprice, p_retailprice, o_totalprice) FROM {W1}
""")
def q_exclude(spark, sf):
    return derive.exclude_columns(V.w1(spark, sf), contains="price")


@register("dropna_rows", dbl=["l_discount", "l_tax"], sql=f"""
SELECT row_key, l_discount, l_tax FROM {W1N} WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL
""")
def q_dropna(spark, sf):
    return derive.dropna_rows(V.w1n(spark, sf).select("row_key", "l_discount", "l_tax"))


@register("to_numeric_coerce", dbl=["area", "qty_text"], sql=f"""
SELECT row_key, TRY_CAST(area AS double) AS area, TRY_CAST(cast(cast(l_quantity AS bigint) AS varchar) AS double) AS qty_text FROM {W1}
""")
def q_to_numeric(spark, sf):
    d = V.w1(spark, sf).select("row_key", "area",
                               F.col("l_quantity").cast("long").cast("string").alias("qty_text"))
    return derive.to_numeric_coerce(d, ["area", "qty_text"])


@register("clip_range", dbl=["l_discount"], sql=f"""
SELECT row_key, least(greatest(l_discount, 0.02e0), 0.08e0) AS l_discount FROM {W1}
""")
def q_clip(spark, sf):
    return derive.clip_range(V.w1(spark, sf).select("row_key", "l_discount"), ["l_discount"], 0.02, 0.08)


@register("row_mean_total", dbl=["l_discount", "l_tax", "rate_total"], sql=f"""
SELECT row_key, l_discount, l_tax, (l_discount + l_tax) / 2e0 AS rate_total FROM {W1N}
""")
def q_row_mean(spark, sf):
    return derive.row_mean_total(V.w1n(spark, sf).select("row_key", "l_discount", "l_tax"),
                                 ["l_discount", "l_tax"], "rate_total")


_Z = ["l_quantity", "l_extendedprice", "c_acctbal"]
_ZI = ["l_quantity", "p_size", "grade"]   # integer-valued: exact sums, identical means in any engine


@register("zscore_columns", dbl=_ZI, sql=f"""
SELECT row_key, {', '.join(f'CASE WHEN stddev_samp({c}) OVER () IS NULL OR stddev_samp({c}) OVER () = 0 THEN {c} * 1e0 '
                           f'ELSE ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () END AS {c}' for c in _ZI)} FROM {W1}
""")
def q_zscore(spark, sf):
    return derive.zscore_columns(V.w1(spark, sf).select("row_key", *_ZI), _ZI)


@register("minmax_columns", dbl=_Z, sql=f"""
SELECT row_key, {', '.join(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-12) AS {c}' for c in _Z)} FROM {W1}
""")
def q_minmax(spark, sf):
    return derive.minmax_columns(V.w1(spark, sf).select("row_key", *_Z), _Z)


@register("sum_normalize", dbl=["revenue", "share"], sql=f"""
WITH r AS (SELECT area, product, sum(l_extendedprice) AS revenue FROM {W1} GROUP BY area, product)
SELECT area, product, revenue, revenue / (sum(revenue) OVER (PARTITION BY area) + 1e-12) AS share FROM r
""")
def q_sum_normalize(spark, sf):
    r = V.w1(spark, sf).groupBy("area", "product").agg(F.sum("l_extendedprice").alias("revenue"))
    return derive.sum_normalize(r, "revenue", "share", by=["area"])


def _names(spark, sf):
    """Feature-name table read off the data (every feature with its |r| to grade)."""
    return stats.corr_with_target(V.w1(spark, sf), FE, "grade").select("feature", "abs_r")


_NAMES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(covar_samp({c}, grade) / nullif(stddev_samp({c}) * stddev_samp(grade), 0)) AS abs_r FROM {W1}"
    for c in FE)


def _domain_case(col: str) -> str:
    items = sorted(DOMAIN_MAP.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    return "(CASE " + " ".join(f"WHEN {col} = '{p}' OR starts_with({col}, '{p}_') THEN '{d}'" for p, d in items) + \
        " ELSE 'other' END)"


def _prefix_case(col: str) -> str:
    items = sorted(DOMAIN_MAP.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    return "(CASE " + " ".join(f"WHEN {col} = '{p}' OR starts_with({col}, '{p}_') THEN '{p}'" for p, _ in items) + " END)"


@register("domain_prefix_tag", dbl=["abs_r"], sql=f"""
SELECT feature, abs_r, {_domain_case('feature')} AS domain FROM ({_NAMES_SQL}) n
""")
def q_domain_tag(spark, sf):
    return derive.domain_prefix_tag(_names(spark, sf), "feature", DOMAIN_MAP)


@register("feature_label", dbl=["abs_r"], sql=f"""
SELECT feature, abs_r, '[' || {_domain_case('feature')} || '] ' ||
  CASE WHEN {_prefix_case('feature')} IS NULL OR feature = {_prefix_case('feature')} THEN feature
       ELSE substring(feature, length({_prefix_case('feature')}) + 2) END AS label
FROM ({_NAMES_SQL}) n
""")
def q_feature_label(spark, sf):
    return derive.feature_label(_names(spark, sf), "feature", DOMAIN_MAP)


@register("feature_rule_tags", dbl=["abs_r"], sql=f"""
SELECT feature, abs_r, concat_ws(',', {', '.join(f"CASE WHEN contains(lower(feature), '{k}') THEN '{t}' END" for k, t in RULES)}) AS tags
FROM ({_NAMES_SQL}) n
""")
def q_rule_tags(spark, sf):
    d = derive.feature_rule_tags(_names(spark, sf), "feature", RULES)
    return d.withColumn("tags", F.array_join("tags", ","))


_RAW_NAMES_SQL = (f"SELECT 'num__' || feature AS name FROM ({_NAMES_SQL}) n UNION ALL "
                  f"SELECT DISTINCT 'cat__area_' || area AS name FROM {W1}")


@register("feature_to_raw", sql=f"""
SELECT name, CASE WHEN starts_with(name, 'num__') THEN substring(name, 6) END AS raw FROM ({_RAW_NAMES_SQL}) n
""")
def q_feature_to_raw(spark, sf):
    names = (_names(spark, sf).select(F.concat(F.lit("num__"), "feature").alias("name"))
             .unionByName(V.w1(spark, sf).select(F.concat(F.lit("cat__area_"), "area").alias("name")).distinct()))
    return derive.feature_to_raw(names, "name")


@register("code_label_map", sql=f"""
SELECT area, n, coalesce(CASE area {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in AREA_LABELS.items())} END, upper(area)) AS label
FROM (SELECT area, count(*) AS n FROM {W1} GROUP BY area) a
""")
def q_code_label(spark, sf):
    a = V.w1(spark, sf).groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    return derive.code_label_map(a, "area", AREA_LABELS)


@register("band_by_threshold", dbl=["ratio"], sql=f"""
WITH c AS (SELECT product, count(*) AS n FROM {W1} GROUP BY product),
r AS (SELECT product, n, n * 1e0 / min(n) OVER () AS ratio FROM c)
SELECT product, n, ratio, CASE WHEN ratio > 1.1 THEN 'high' WHEN ratio > 1.05 THEN 'mid' ELSE 'low' END AS band FROM r
""")
def q_band(spark, sf):
    c = V.w1(spark, sf).groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    r = c.withColumn("ratio", F.col("n") * 1.0 / F.min("n").over(Window.partitionBy(F.lit(1))))
    return derive.band_by_threshold(r, "ratio", [(1.1, "high"), (1.05, "mid")], "low")


@register("near_best_band", dbl=["mean_value"], sql=f"""
WITH m AS (SELECT metric, model, avg(value) AS mean_value FROM {RS} WHERE condition = 'unweighted' GROUP BY metric, model),
b AS (SELECT *, max(mean_value) OVER (PARTITION BY metric) AS best FROM m)
SELECT metric, model, mean_value, CASE WHEN best - mean_value = 0 THEN 'best'
  WHEN best - mean_value <= abs(best) * 0.01 THEN 'near' WHEN best - mean_value <= abs(best) * 0.03 THEN 'close'
  ELSE 'other' END AS band FROM b
""")
def q_near_best(spark, sf):
    m = (V.rs_view(spark, sf).where("condition = 'unweighted'")
         .groupBy("metric", "model").agg(F.avg("value").alias("mean_value")))
    return derive.near_best_band(m, "metric", "mean_value", near=0.01, close=0.03)
