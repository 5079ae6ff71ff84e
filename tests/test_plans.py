"""Plan guards: the physical plans we rely on at scale."""

import pytest

from conftest import SF01

import __spark_entry__ as E
from custlytics.operators import rfm as R
from custlytics.sources import testdata as TD


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_is_take_ordered(spark):
    df = E.queries()["top_risk"](spark, SF01)
    assert "TakeOrderedAndProject" in _plan(df)


def test_scan_prunes_columns(spark):
    text = _plan(E.queries()["rfm"](spark, SF01))
    assert "o_orderpriority" not in text and "o_totalprice" in text
    assert "Join" not in text                    # RFM is one aggregation


def test_scoring_ranks_without_one_task_window(spark):
    feats = R.rfm(TD.transactions(spark, SF01, lines=False), sort=False)
    text = _plan(R.score_customers(feats))
    # scores are a projection of the stored table
    assert not any(x in text for x in ("Window", "SinglePartition", "Sort", "Join", "Exchange"))


def test_kpi_row_counts_without_expand(spark):
    assert "Expand" not in _plan(E.queries()["kpi_row"](spark, SF01))


@pytest.mark.parametrize("name", ["box_clv", "box_churn_probability"])
def test_box_plots_do_not_shuffle_customers(spark, name):
    df = E.queries()[name](spark, SF01)
    df.collect()
    text = _plan(df).split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "rangepartitioning(segment" not in text.split("HashAggregate")[-1]


def test_split_is_a_comparison(spark):
    text = _plan(E.queries()["stratified_split"](spark, SF01))
    assert not any(x in text for x in ("Window", "Sort", "Join", "Exchange"))


def test_risk_summary_broadcasts_its_aggregate(spark):
    assert "BroadcastHashJoin" in _plan(E.queries()["risk_summary"](spark, SF01))


def test_churn_has_no_nested_loop_join(spark):
    text = _plan(E.queries()["customer_churn"](spark, SF01))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_category_distribution_aggregates_before_join(spark):
    text = _plan(E.queries()["dist_category"](spark, SF01))
    join_at = text.find("Join")
    # a partial count on the line side sits below the join
    assert join_at >= 0 and "HashAggregate" in text[join_at:]


def test_trailing_window_filter_reaches_the_scan(spark):
    text = _plan(E.queries()["recent_activity"](spark, SF01))
    assert "GreaterThanOrEqual(o_orderdate" in text


def test_end_date_is_a_literal_not_a_repeated_subquery(spark):
    text = _plan(E.queries()["customer_churn"](spark, SF01))
    assert "Subquery" not in text


def test_view_filters_push_down(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        text = _plan(E.queries()["filtered_customers"](spark, SF01))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = text.split("PushedFilters: [", 1)[1].split("ReadSchema", 1)[0]
    assert "GreaterThanOrEqual(clv_proxy" in pushed and "In(segment" in pushed


# attributions and boosted trees are numpy jobs over batches; the training-data operators have plan tests of their own
JVM = sorted(n for n in E.oracle_sql() if n not in ("tree_attributions_check", "attribution_summary_check", "boosted_model_roundtrip") and n != "pipeline"
             and not n.startswith("op"))


@pytest.mark.parametrize("name", JVM)
def test_sql_checked_queries_stay_in_the_jvm(spark, name):
    text = _plan(E.queries()[name](spark, SF01))
    for marker in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert marker not in text, (name, marker)
