"""Column-expression helpers.

Several helpers return *SQL text* rather than a Column: the same text is valid
in Spark SQL and in DuckDB, so a query and its independent SQL check evaluate a
formula with the same IEEE operations. Literals are written ``1.5e0`` so both
engines read them as DOUBLE (a bare ``1.5`` is DECIMAL in Spark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """Missing = NULL everywhere (pandas NaN semantics, N1)."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c.cast("double"))


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI mode raises on 0 otherwise, N15)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def sql_safe_div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def clip(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(float(lo))), F.lit(float(hi)))


def round_sig_sql(x: str, sig: int = 9, min_exp: int = -12) -> str:
    """Round to ``sig`` significant digits, never finer than ``10**min_exp``.

    Written with exact powers of ten and floor(+0.5) so Spark and DuckDB give
    bit-identical results for identical inputs; used only at the checking
    boundary, operators themselves keep full precision.
    """
    e = f"least({sig - 1} - floor(log10(abs({x}))), {-min_exp})"
    return (
        f"(CASE WHEN ({x}) IS NULL OR ({x}) = 0 THEN ({x}) "
        f"WHEN {e} >= 0 THEN floor(({x}) * pow(10e0, {e}) + 0.5e0) / pow(10e0, {e}) "
        f"ELSE floor(({x}) / pow(10e0, -({e})) + 0.5e0) * pow(10e0, -({e})) END)"
    )


# powers that a double holds exactly; pow() gives the same numbers (tested)
_TENS = "array(" + ", ".join(f"1e{i}D" for i in range(23)) + ")"


def round_sig_columns(df: DataFrame, cols: list[str], sig: int = 9, min_exp: int = -12) -> DataFrame:
    """``df`` with ``cols`` rounded as ``round_sig_sql`` does, to the same bits. A number's
    exponent and its power of ten are columns of their own, so that each is computed once and
    not again in every branch (logarithms and powers were most of the time of long tables)."""
    at = {c: i for i, c in enumerate(cols)}
    tens = df.select("*", *[F.expr(f"least({sig - 1} - floor(log10(abs(`{c}`))), {-min_exp})").alias(f"__e{i}") for c, i in at.items()])
    tens = tens.select("*", *[F.expr(f"CASE WHEN abs(__e{i}) <= 22 THEN get({_TENS}, cast(abs(__e{i}) AS int)) "
                                     f"ELSE pow(10e0, abs(__e{i})) END").alias(f"__t{i}") for i in at.values()])
    done = lambda c, i: F.expr(
        f"CASE WHEN `{c}` IS NULL OR `{c}` = 0 THEN `{c}` WHEN __e{i} >= 0 THEN floor(`{c}` * __t{i} + 0.5e0) / __t{i} "
        f"ELSE floor(`{c}` / __t{i} + 0.5e0) * __t{i} END").cast("double").alias(c)
    return tens.select(*[done(c, at[c]) if c in at else F.col(f"`{c}`") for c in df.columns])


def average_rank_expr(rank_col: str = "rk", peers_col: str = "peers") -> Column:
    """pandas average rank from min rank and tie-group size (N13)."""
    return F.col(rank_col) + (F.col(peers_col) - 1) / 2.0


def band_expr(c, thresholds: list[tuple[float, str]], default: str, op: str = ">") -> Column:
    """Value -> label by ordered thresholds (F-15). First matching wins."""
    c = col(c)
    out = None
    for t, label in thresholds:
        cond = {">": c > t, ">=": c >= t, "<": c < t, "<=": c <= t}[op]
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)
