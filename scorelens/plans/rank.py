"""Distributed average rank and running sums.

``Window.partitionBy(g).orderBy(v)`` puts a whole group into one task, and a
window with no partition plans ``Exchange SinglePartition``. Both break when one
group holds a third of the rows. The plan here:

1. collapse to distinct ``(group, value) -> weight`` (a hot value becomes one
   row with a large weight, so value skew disappears);
2. ``repartitionByRange(group, value)`` spreads every group over many tasks;
   the partition id is frozen by a reliable checkpoint in the shared
   checkpoint folder (recomputation after an executor loss sees the same ids);
3. per-(partition, group) weight totals -> prefix offsets: at most
   ``partitions + groups`` rows, so that AQE broadcasts them;
4. a running sum inside each range partition (bounded task size).

Average rank (pandas / scipy convention, N13) of a value with weight ``w``
is ``before + (w + 1) / 2`` where ``before`` counts rows with a smaller value
in the same group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.plans.helpers import checkpoint


def collapse(df: DataFrame, groups: list[str], value: str, weight: str = "w") -> DataFrame:
    """Distinct (group, value) with row counts; NULL values are not ranked."""
    return (df.where(F.col(value).isNotNull())
              .groupBy(*groups, value).agg(F.count(F.lit(1)).alias(weight)))


def distributed_cumsum(counts: DataFrame, groups: list[str], order: list, weights: list[str],
                       num_partitions: int | None = None, fold: list | None = None) -> DataFrame:
    """For every weight column ``x`` add ``before_x`` (sum of x over rows strictly
    ahead in the group order) and ``total_x`` (group total). ``order`` holds
    Columns or names; rows must be unique on (groups, order). One plan for all sizes.

    With ``fold`` (aggregates, the weights among them) several rows may share (groups,
    order): they meet in one range partition and become one row there, without a
    further shuffle."""
    spark = counts.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ocols = [F.col(o) if isinstance(o, str) else o for o in order]
    keyed = counts.select("*", *[c.alias(f"__k{i}") for i, c in enumerate(ocols)])
    kcols = [f"__k{i}" for i in range(len(ocols))]
    part = keyed.repartitionByRange(n, *[F.col(g) for g in groups], *[F.col(k) for k in kcols])
    names = counts.columns
    if fold:
        part = part.groupBy(*groups, *kcols).agg(*fold)
        names = [c for c in part.columns if c not in kcols]
    part = checkpoint(part.withColumn("__pid", F.spark_partition_id()))

    tot = part.groupBy("__pid", *groups).agg(*[F.sum(w).alias(f"__pt_{w}") for w in weights])
    wg = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    wprev = wg.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("__pid", *groups,
                      *[F.coalesce(F.sum(f"__pt_{w}").over(wprev), F.lit(0)).alias(f"__off_{w}") for w in weights],
                      *[F.sum(f"__pt_{w}").over(wg).alias(f"total_{w}") for w in weights])

    wl = (Window.partitionBy("__pid", *groups).orderBy(*kcols)
          .rowsBetween(Window.unboundedPreceding, 0))
    local = part.select("*", *[(F.sum(w).over(wl) - F.col(w)).alias(f"__loc_{w}") for w in weights])
    out = local.join(offs, ["__pid", *groups])
    return out.select(*names, *(kcols if fold else []),
                      *[(F.col(f"__off_{w}") + F.col(f"__loc_{w}")).alias(f"before_{w}") for w in weights],
                      *[F.col(f"total_{w}") for w in weights])


def distributed_rank(counts: DataFrame, groups: list[str], value: str, weight: str = "w",
                     ascending: bool = True, num_partitions: int | None = None) -> DataFrame:
    """Add ``before`` (rows strictly ahead in the group), ``avg_rank``,
    ``min_rank`` and ``group_n`` to a table of distinct (group, value, weight)."""
    key = F.col(value) if ascending else -F.col(value)
    r = distributed_cumsum(counts, groups, [key], [weight], num_partitions)
    before = F.col(f"before_{weight}").cast("long")
    return r.select(*counts.columns, before.alias("before"),
                    (before + (F.col(weight) + 1) / 2.0).alias("avg_rank"),
                    (before + 1).alias("min_rank"), F.col(f"total_{weight}").cast("long").alias("group_n"))


def ranked_with_classes(df: DataFrame, groups: list[str], value: str, cls: str,
                        num_partitions: int | None = None) -> DataFrame:
    """Distinct (group, value) with the row count ``w``, the class counts ``by_class``
    (an array of (cls, __n), only classes that occur), ``before``, ``avg_rank`` and
    ``group_n``. Rank sums, bins and ties of classes come from this one running sum;
    nothing is joined back on (group, value). Rows with a NULL value or class are left out."""
    c = (df.where(F.col(value).isNotNull() & F.col(cls).isNotNull())
           .groupBy(*groups, value, cls).agg(F.count(F.lit(1)).alias("__n")))
    r = distributed_cumsum(c, groups, [value], ["w"], num_partitions,
                           fold=[F.sum("__n").alias("w"), F.collect_list(F.struct(cls, "__n")).alias("by_class")])
    before = F.col("before_w").cast("long")
    return r.select(*groups, F.col("__k0").alias(value), "w", "by_class", before.alias("before"),
                    (before + (F.col("w") + 1) / 2.0).alias("avg_rank"), F.col("total_w").cast("long").alias("group_n"))


# (sampled rows of a group, half width of an interval as a share of the group's rows): five
# standard errors of a sampled median and more; smaller groups keep all their values
_MARGINS = [(10_000, 0.025), (1_000_000, 0.003), (100_000_000, 0.0004)]


def _selected(df: DataFrame, groups: list[str], value: str, probs: list[float], fraction: float,
              margins: list[tuple[int, float]]) -> DataFrame:
    """(groups, vmin, vmax, w, before_w, total_w) with a row per distinct value near a wanted
    position and one row per stretch of values between them."""
    marks = [min(max(p + d, 0.0), 1.0) for _, m in margins for p in probs for d in (-m, m)]
    s = df.sample(fraction, seed=7)
    near = (s.groupBy(*groups) if groups else s.groupBy()).agg(
        F.count(F.lit(1)).alias("__m"), F.percentile_approx(value, marks, 20_000).alias("__all"))
    width = 2 * len(probs)
    pick = F.lit(None)
    for t, (rows, _) in enumerate(margins):
        pick = F.when(F.col("__m") >= rows, F.slice("__all", t * width + 1, width)).otherwise(pick)
    near = near.select(*groups, pick.alias("__near")).select(                     # one row per group
        *groups, *[F.col("__near")[k].alias(f"__b{k}") for k in range(width)])
    # broadcast by name: by size the planner may shuffle all rows by group, a feature to a task
    near = F.broadcast(near)
    x = df.join(near, groups, "left") if groups else df.crossJoin(near)
    v = F.col(value)
    inside, above = F.col("__b0").isNull(), F.lit(0)      # no interval: every value is kept
    for k in range(len(probs)):
        inside = inside | v.between(F.col(f"__b{2 * k}"), F.col(f"__b{2 * k + 1}"))
        above = above + (v > F.col(f"__b{2 * k + 1}")).cast("int")
    kept = x.select(*groups, v.alias("__v"), inside.alias("__in"), above.alias("__above"))
    c = kept.groupBy(*groups, F.when(F.col("__in"), F.col("__v")).alias("__same"),
                     F.when(~F.col("__in"), F.col("__above")).alias("__stretch")).agg(
        F.min("__v").alias("vmin"), F.max("__v").alias("vmax"), F.count(F.lit(1)).alias("w"))
    return distributed_cumsum(c.drop("__same", "__stretch"), groups, ["vmin"], ["w"])


def quantile_arrays(df: DataFrame, groups: list[str], value: str, probs: list[float], fraction: float = 0.02,
                    margins: list[tuple[int, float]] = _MARGINS) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas / ``quantile_cont``) per group, by
    selection: groups..., ``_q`` (an array in the order of ``probs``).

    Sampled rows name an interval around each wanted position; one aggregation over all rows
    then counts every distinct value inside the intervals and, as one row each, the
    stretches between them. No row is sorted; what is ranked is twice the margin of the
    values per probability. The sample never decides: a position that falls inside a
    stretch (only its ends are known) sends its group through a further selection from all
    its distinct values. NULL values and groups are left out."""
    d = df.where(F.col(value).isNotNull()).select(*groups, value)
    order = sorted(set(float(p) for p in probs))
    wanted = [(p, end) for p in order for end in (F.floor, F.ceil)]

    def read(r: DataFrame) -> DataFrame:
        cols, lost = [], F.lit(False)
        b, w = F.col("before_w"), F.col("w")
        for k, (p, end) in enumerate(wanted):
            pos = end((F.col("total_w") - 1) * F.lit(p))
            here = (b <= pos) & (pos < b + w)
            cols.append(F.max(F.when(here, F.when(pos == b, F.col("vmin")).otherwise(F.col("vmax")))).alias(f"__x{k}"))
            lost = lost | (here & (pos != b) & (pos != b + w - 1) & (F.col("vmin") != F.col("vmax")))
        g = r.groupBy(*groups) if groups else r.groupBy()
        return g.agg(F.first("total_w").alias("__n"), F.max(lost).alias("__lost"), *cols)

    picked = read(_selected(d, groups, value, order, fraction, margins))
    if not picked.where("__lost").isEmpty():
        again = picked.where("__lost").select(*groups)
        rest = d.join(again, groups, "left_semi") if groups else d
        c = collapse(rest, groups, value).select(*groups, F.col(value).alias("vmin"), F.col(value).alias("vmax"), "w")
        picked = picked.where("NOT __lost").unionByName(read(distributed_cumsum(c, groups, ["vmin"], ["w"])))
    out = {}
    for k, p in enumerate(order):
        h = (F.col("__n") - 1) * F.lit(p)
        lo, hi = F.col(f"__x{2 * k}"), F.col(f"__x{2 * k + 1}")
        out[p] = lo + (h - F.floor(h)) * (hi - lo)
    return picked.where("__n IS NOT NULL").select(*groups, F.array(*[out[float(p)] for p in probs]).alias("_q"))


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float]) -> DataFrame:
    """``quantile_arrays`` as rows: groups..., ``p``, ``q``."""
    q = quantile_arrays(df, groups, value, probs)
    return q.select(*groups, F.inline(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"),
                                                   F.col("_q").alias("q"))).alias("p", "q"))


def nth_rows(rows: DataFrame, order: list[str], groups: list[str], n: str) -> DataFrame:
    """The ``n``-th row (from 1, a column of ``rows`` constant in a group) of every group:
    groups..., order columns as ``__c0``, ``__c1``, ..."""
    p = row_position(rows.select(*groups, *order, n), order, groups, out="__at")
    return p.where(F.col("__at") == F.col(n) - 1).select(*groups, *[F.col(o).alias(f"__c{i}") for i, o in enumerate(order)])


def average_rank_rows(df: DataFrame, value: str, groups: list[str] | None = None,
                      ascending: bool = True, out: str = "rank") -> DataFrame:
    """Per-row average rank: collapse, rank distributed, join back on (group, value)."""
    groups = groups or []
    c = collapse(df, groups, value)
    r = distributed_rank(c, groups, value, ascending=ascending).select(*groups, value, "avg_rank")
    return df.join(r, [*groups, value], "left").withColumnRenamed("avg_rank", out)


def row_position(df: DataFrame, order: list, groups: list[str] | None = None, out: str = "pos") -> DataFrame:
    """0-based position of every row in (groups, order); ``order`` must be unique
    within a group (add a key). Same range-partitioned plan, weight 1 per row."""
    groups = groups or []
    d = df.withColumn("__one", F.lit(1))
    r = distributed_cumsum(d, groups, order, ["__one"])
    return r.withColumnRenamed("before___one", out).withColumnRenamed("total___one", f"{out}_n").drop("__one")
