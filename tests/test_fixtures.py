"""Hand-made edge cases (one per quirk of the reference's semantics)."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import make_tx

from custlytics.operators import cohort as C
from custlytics.operators import customer as E
from custlytics.operators import ml as M
from custlytics.operators import quality as Q
from custlytics.operators import rfm as R
from custlytics.operators import views as V
from custlytics.operators.rank import global_rank
from custlytics.operators.attribution import Node, attributions_matrix


def test_inactivity_boundary_90_vs_91(spark):
    tx = make_tx(spark, [("t1", "A", "2025-10-02", 10.0), ("t2", "B", "2025-10-01", 10.0),
                         ("t3", "C", "2025-12-31", 10.0)])
    out = {r.customer_id: r for r in E.customer_churn(tx).collect()}
    assert out["A"].days_since_last_purchase == 90 and out["A"].churn_label == 0
    assert out["A"].transactions_last_90_days == 1
    assert out["B"].days_since_last_purchase == 91 and out["B"].churn_label == 1
    assert out["B"].transactions_last_90_days == 0 and out["B"].spend_last_90_days == 0.0


def test_time_of_day_is_ignored(spark):
    tx = make_tx(spark, [("t1", "A", "2025-12-30 23:59", 1.0), ("t2", "B", "2025-12-31 00:01", 1.0)])
    out = {r.customer_id: r.recency for r in R.rfm(tx).collect()}
    assert out == {"A": 1, "B": 0}


def test_tied_frequency_bigger_spender_ranks_first(spark):
    rows = [("a1", "A", "2025-01-01", 100.0), ("a2", "A", "2025-01-02", 100.0),
            ("b1", "B", "2025-01-01", 10.0), ("b2", "B", "2025-01-02", 10.0)]
    feats = R.rfm(make_tx(spark, rows), sort=False)
    ranks = {r.customer_id: r.rank for r in global_rank(feats, R.FREQUENCY_ORDER).collect()}
    assert ranks == {"A": 1, "B": 2}


@pytest.mark.parametrize("n,sizes", [(5, [2, 1, 1, 1]), (6, [2, 1, 1, 2]), (7, [2, 2, 1, 2])])
def test_rank_quartiles_are_not_ntile(spark, n, sizes):
    df = spark.range(1, n + 1).withColumnRenamed("id", "r")
    got = df.select(R.rank_quartile_score("r", n).alias("s")).groupBy("s").count().orderBy("s").collect()
    assert [r["count"] for r in got] == sizes


def test_duplicate_recency_edges_raise_or_drop(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (0,), (1,)], "recency int")
    edges = R.value_quartile_edges(df, "recency")
    with pytest.raises(ValueError):
        R.quartile_score("recency", edges, R.RECENCY_LABELS)
    scored = df.select(R.quartile_score("recency", edges, R.RECENCY_LABELS, duplicates="drop").alias("s"))
    assert sorted({r.s for r in scored.collect()}) == [1]      # one bin [0, 1] remains
    df2 = spark.createDataFrame([(v,) for v in (0, 0, 0, 1, 2, 3, 4, 5)], "recency int")
    e2 = R.value_quartile_edges(df2, "recency")                  # 0, 0, 1.5, 3.25, 5
    s2 = df2.select(R.quartile_score("recency", e2, R.RECENCY_LABELS, duplicates="drop").alias("s"))
    assert [r.s for r in s2.collect()] == [3, 3, 3, 3, 2, 2, 1, 1]


@pytest.mark.parametrize("scores,segment", [((3, 1, 4), "Low-Engagement"), ((3, 2, 1), "Repeat"),
                                            ((2, 2, 2), "At-Risk"), ((2, 3, 1), "Low-Engagement"),
                                            ((4, 4, 3), "High-Value")])
def test_segment_rules(spark, scores, segment):
    df = spark.createDataFrame([scores], "r_score int, f_score int, m_score int")
    row = df.select(R.assign_segment().alias("s"), R.rfm_score().alias("t")).first()
    assert row.s == segment and row.t == "".join(map(str, scores))


def test_cohort_december_then_january(spark):
    tx = make_tx(spark, [("t1", "A", "2024-12-15", 1.0), ("t2", "A", "2025-01-03", 1.0)])
    got = sorted((r.order_month, r.cohort_month, r.cohort_index) for r in C.cohort_assign(tx).collect())
    assert got == [("2024-12", "2024-12", 1), ("2025-01", "2024-12", 2)]


def test_silent_month_is_absent_and_null_in_matrix(spark):
    tx = make_tx(spark, [("t1", "A", "2025-01-10", 1.0), ("t2", "A", "2025-03-10", 1.0),
                         ("t3", "B", "2025-01-11", 1.0)])
    ret = C.cohort_retention(tx)
    cells = {(r.cohort_month, r.cohort_index): r.retention_rate for r in ret.collect()}
    assert cells == {("2025-01", 1): 1.0, ("2025-01", 3): 0.5}
    m = C.cohort_matrix(ret, indexes=[1, 2, 3]).first()
    assert m.month_1 == 1.0 and m.month_2 is None and m.month_3 == 0.5


def test_risk_band_edges_and_kpi_threshold(spark):
    ps = [0.0, 0.3, 0.7, 0.70001, 1.0, 1.1, -0.01]
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(ps)], "customer_id string, churn_probability double")
    got = [r.b for r in df.select(V.risk_band().alias("b")).collect()]
    assert got == ["Low Risk", "Low Risk", "Medium Risk", "High Risk", "High Risk", None, None]
    full = df.withColumn("clv_proxy", F.lit(1.0)).withColumn("frequency", F.lit(1)) \
        .withColumn("monetary", F.lit(1.0))
    k = V.kpis(full).first()
    assert k.high_risk_customers == 4     # 0.7, 0.70001, 1.0, 1.1


def test_risk_summary_keeps_empty_bands(spark):
    df = spark.createDataFrame([("a", 0.9, 10.0), ("b", 0.95, 20.0)],
                               "customer_id string, churn_probability double, clv_proxy double")
    rows = V.risk_summary(df).collect()
    assert [r.risk_band for r in rows] == ["Low Risk", "Medium Risk", "High Risk"]
    assert [r.customers for r in rows] == [0, 0, 2]
    assert rows[0].avg_clv_proxy is None and rows[2].avg_clv_proxy == 15.0


def test_quality_checks_count_each_problem_once(spark):
    from custlytics.sources.transactions import parse_transactions
    raw = spark.createDataFrame([
        (None, "A", "2025-01-01", 5.0, 1), ("t2", None, "2025-01-01", 5.0, 1),
        ("t3", "B", "2025-01-01", 5.0, 1), ("t3", "B", "2025-01-02", 5.0, 1),
        ("t5", "C", "2025-01-01", 0.0, 1), ("t6", "C", "2025-01-01", 5.0, -1),
        ("t7", "D", "not a date", 5.0, 1)],
        "transaction_id string, customer_id string, transaction_date string, order_value double, quantity bigint")
    tx = parse_transactions(raw)
    nulls = Q.null_counts(tx).first()
    assert (nulls.null_transaction_id, nulls.null_customer_id, nulls.null_transaction_date) == (1, 1, 1)
    assert [tuple(r) for r in Q.duplicate_ids(tx).collect()] == [("t3", 2)]
    assert Q.nonpositive_rows(tx, "order_value", "n").first().n == 1
    assert Q.nonpositive_rows(tx, "quantity", "n").first().n == 1
    suite = {r.metric: (r.value, r.status) for r in Q.run_validation(tx).collect()}
    assert suite["duplicate_ids"] == ("1", "FAIL") and suite["null_customer_id"] == ("1", "FAIL")
    assert suite["total_transactions"] == ("7", "INFO")


def test_null_counts_on_empty_table_are_null(spark):
    tx = make_tx(spark, []) if False else spark.createDataFrame(
        [], "transaction_id string, customer_id string, transaction_date timestamp_ntz, "
            "order_value double, quantity bigint")
    assert Q.null_counts(tx).first().null_transaction_id is None


def test_half_cent_average_rounds_up(spark):
    tx = make_tx(spark, [("t1", "A", "2025-01-01", 0.01), ("t2", "A", "2025-01-02", 0.02)])
    row = E.customer_churn(tx).first()
    assert row.avg_order_value == 0.02 and row.total_spend == 0.03


def test_clv_from_rounded_aov(spark):
    tx = make_tx(spark, [("t1", "A", "2025-01-01", 10.0), ("t2", "A", "2025-02-01", 20.01)])
    row = E.customer_churn(tx).first()
    # 2 x 15.01 (rounded 15.005) x 2 / 12 = 5.0033 -> 5.00
    assert row.active_months == 2 and row.avg_order_value == 15.01 and row.clv_proxy == 5.0
    raw = E.customer_churn(tx, rounded=False).first()
    assert raw.clv_proxy == 5.0 and abs(raw.avg_order_value - 15.005) < 1e-12


def test_one_class_report_has_null_precision(spark):
    pred = spark.createDataFrame([(0, 0), (0, 0), (0, 0)], "churn_label int, prediction int")
    rows = {r["class"]: r for r in M.classification_report(pred).collect()}
    assert rows["1"].precision is None and rows["1"].recall is None and rows["1"].support == 0
    assert rows["accuracy"].f1_score == 1.0
    cm = [tuple(r) for r in M.confusion_matrix(pred).collect()]
    assert cm == [(0, 0, 3), (0, 1, 0), (1, 0, 0), (1, 1, 0)]


def test_auc_rank_sum_matches_evaluator(spark):
    rng = np.random.default_rng(5)
    rows = [(int(y), float(np.round(s, 2))) for y, s in zip(rng.integers(0, 2, 400), rng.random(400))]
    df = spark.createDataFrame(rows, "churn_label int, churn_probability double")
    auc = M.roc_auc(df, partitions=16).first().roc_auc
    assert auc == round(M.evaluator_auc(df) + 1e-12, 4)


def test_split_is_disjoint_cover_and_stratified(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1000)], "customer_id long, churn_label int")
    s = M.stratified_split(df).toPandas()
    assert len(s) == 1000 and s.customer_id.is_unique
    test = s[s.split == "test"]
    assert len(test) == 200 and (test.churn_label == 1).sum() == 40
    assert set(s[s.split == "train"].fold.unique()) == {0, 1, 2}


def _brute_shapley(x, root, nf):
    """Shapley values by enumerating all subsets of the features."""
    def v(S, node):
        if node.feature < 0:
            return node.value
        if node.feature in S:
            return v(S, node.left if x[node.feature] <= node.limit else node.right)
        return sum(child.share * v(S, child) for child in (node.left, node.right))

    phi = np.zeros(nf)
    for f in range(nf):
        others = [g for g in range(nf) if g != f]
        for k in range(nf):
            for S in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(nf - k - 1) / math.factorial(nf)
                phi[f] += w * (v({*S, f}, root) - v(set(S), root))
    return phi


def test_attributions_equal_brute_force():
    # x0 <= 1 ? (x1 <= 5 ? 1.0 : 2.0) : (x0 <= 3 ? 3.0 : 4.0): x0 twice on a path
    root = Node(1.0, feature=0, limit=1, left=Node(0.5, feature=1, limit=5, left=Node(0.4, 1.0), right=Node(0.6, 2.0)),
                right=Node(0.5, feature=0, limit=3, left=Node(0.7, 3.0), right=Node(0.3, 4.0)))
    xs = np.array([[0.5, 4.0], [0.5, 9.0], [2.0, 0.0], [7.0, 7.0]])
    got = attributions_matrix(xs, [root], 2)
    for x, g in zip(xs, got):
        assert np.allclose(g, _brute_shapley(x, root, 2), atol=1e-12)


@pytest.mark.parametrize("depth", [1, 2, 5, 8])
def test_attributions_of_drawn_trees_equal_brute_force(depth):
    """Four features on paths of up to eight tests, so all of them repeat;
    some children hold nothing."""
    rng = np.random.default_rng(depth)

    def drawn(d, share):
        if d == 0 or rng.random() < 0.05:
            return Node(share, float(rng.normal()))
        left = float(rng.choice([0.0, 1.0, rng.random(), rng.random(), rng.random()]))
        return Node(share, 0.0, int(rng.integers(4)), float(rng.normal()), drawn(d - 1, left), drawn(d - 1, 1 - left))

    xs = np.vstack([rng.normal(size=(12, 4)), np.zeros((1, 4))])
    for _ in range(6):
        root = drawn(depth, 1.0)
        got = attributions_matrix(xs, [root, root], 4)
        for x, g in zip(xs, got):
            assert np.allclose(g, 2 * _brute_shapley(x, root, 4), atol=1e-10)


def test_single_leaf_tree_has_zero_attributions():
    root = Node(1.0, 0.7)
    assert (attributions_matrix(np.array([[1.0, 2.0]]), [root], 2) == 0).all() and root.expected() == 0.7
    assert attributions_matrix(np.zeros((0, 2)), [root], 2).shape == (0, 2)


def test_top_n_ties_break_by_id(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "customer_id string, churn_probability double")
    assert [r.customer_id for r in V.top_n(df, "churn_probability", 2).collect()] == ["c", "a"]


def test_require_rows(spark):
    df = spark.createDataFrame([], "customer_id string")
    with pytest.raises(V.EmptySelection):
        V.require_rows(df)


def test_points_are_all_customers(spark):
    df = spark.range(1000).select(F.col("id").alias("customer_id"), F.lit("s").alias("segment"),
                                  F.rand(1).alias("clv_proxy"), F.rand(2).alias("churn_probability"))
    assert V.points(df).count() == 1000


def test_order_month_and_cohort_filters(spark):
    tx = make_tx(spark, [("t1", "A", "2024-12-15", 1.0), ("t2", "A", "2025-01-03", 1.0),
                         ("t3", "B", "2025-02-01", 1.0)])
    assert sorted(r.order_month for r in C.with_order_month(tx).collect()) == ["2024-12", "2025-01", "2025-02"]
    ret = C.cohort_retention(tx)
    assert [r.cohort_month for r in C.cohort_options(ret).collect()] == ["2024-12", "2025-02"]
    only = C.filter_cohorts(ret, max_index=1, cohorts=["2025-02"]).collect()
    assert [(r.cohort_month, r.cohort_index) for r in only] == [("2025-02", 1)]
    latest = C.latest_retention(ret).collect()
    assert [(r.cohort_month, r.cohort_index) for r in latest] == [("2024-12", 2), ("2025-02", 1)] or \
        [(r.cohort_month, r.cohort_index) for r in latest] == [("2025-02", 1), ("2024-12", 2)]


def test_validation_checks_by_name(spark):
    tx = make_tx(spark, [("t1", "A", "2025-01-01", 5.0, 1, 0.0, "web"), ("t1", "B", "2025-01-02", 5.0, 1, 0.0, "app"),
                         ("t3", "B", "2025-01-03", 5.0, 1, 0.0, "app")])
    checks = {c.name: c for c in Q.run_checks(tx, preview=1)}
    assert len(checks) == 12
    assert checks["category_distribution"].error and checks["state_distribution"].error      # no such columns: only these fail
    assert sum(c.error is None for c in checks.values()) == 10
    assert checks["duplicate_ids"].rows == [("t1", 2)] and checks["duplicate_ids"].total == 1
    assert checks["channel_distribution"].rows == [("app", 2)] and checks["channel_distribution"].total == 2
    assert [tuple(r) for r in Q.validation_checks(tx)["channel_distribution"]().collect()] == [("app", 2), ("web", 1)]


def test_validation_suite_on_empty_table(spark):
    tx = spark.createDataFrame([], "transaction_id string, customer_id string, transaction_date timestamp_ntz, "
                                   "order_value double, quantity bigint")
    got = {r.metric: (r.value, r.status) for r in Q.run_validation(tx).collect()}
    assert got["total_transactions"] == ("0", "INFO") and got["total_customers"] == ("0", "INFO")
    assert got["null_customer_id"] == (None, "NO DATA")       # SQL SUM over no rows is NULL
    assert got["non_positive_order_value_rows"] == ("0", "PASS")
    assert got["duplicate_ids"] == ("0", "PASS") and got["min_transaction_date"] == (None, "INFO")
