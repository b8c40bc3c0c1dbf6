"""The order-line view: its columns, and how it is joined."""

from scorelens.plans import views as V

from conftest import SF_SMALL


def test_view_equals_its_join(spark):
    w, joined = V.w1(spark, SF_SMALL), V.w1_join(spark, SF_SMALL)
    assert joined.columns == w.columns == V.W1_COLUMNS
    assert w.exceptAll(joined).isEmpty() and joined.exceptAll(w).isEmpty()


def test_lines_and_orders_are_merged_at_every_size(spark):
    plan = V.w1_join(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    merged = [x for x in plan.splitlines() if "SortMergeJoin" in x]
    assert len(merged) == 1 and "l_orderkey" in merged[0] and "o_orderkey" in merged[0]
