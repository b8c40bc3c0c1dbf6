"""Plan-shape checks: pushdown / pruning reach the scan, no cartesian product or
single-partition exchange over raw rows, one scan for all segment columns."""

from scorelens.operators import agg, derive, stats
from scorelens.plans import views as V

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    w = V.w1(spark, SF_SMALL)
    d = derive.filter_eq_in(w, eq={"area": "ASIA"}, isin={"product": ["SMALL"]}).select("row_key", "l_quantity")
    p = _plan(d)
    pushed = p.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "EqualTo(area,ASIA)" in pushed and "EqualTo(product,SMALL)" in pushed
    assert "ReadSchema: struct<row_key:string,area:string,product:string,l_quantity:double>" in p


def test_segment_kpi_is_one_scan(spark):
    p = _plan(agg.segment_kpi(V.w1(spark, SF_SMALL), V.SEGMENTS, "grade", ["l_extendedprice"]))
    assert p.count("FileScan parquet") == 1
    assert "Expand" in p


def test_rank_tests_have_no_cartesian_or_single_partition_on_rows(spark):
    w = V.w1(spark, SF_SMALL)
    for df in (stats.kruskal_wallis(w, V.FEATURES, "grade"),
               stats.mann_whitney_u(w, "l_quantity", "grade", 1),
               stats.corr_with_target(w, V.FEATURES, "grade")):
        p = _plan(df)
        assert "CartesianProduct" not in p
        # a single-partition exchange only ever gets aggregated rows: below it stands an
        # aggregate before any scan or exchange of rows
        lines = p.splitlines()
        for i, line in enumerate(lines):
            if "SinglePartition" not in line:
                continue
            depth = len(line) - len(line.lstrip(" :+-"))
            below = []
            for x in lines[i + 1:]:
                if len(x) - len(x.lstrip(" :+-")) <= depth:
                    break
                below.append(x)
            first = next(k for k, x in enumerate(below) if "Aggregate" in x or "Scan" in x or "Exchange" in x)
            assert "Aggregate" in below[first], "\n".join([line, *below])
