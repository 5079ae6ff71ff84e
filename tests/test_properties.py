
from pyspark.sql import functions as F

from conftest import SF01

from custlytics.operators import cohort as C
from custlytics.operators import customer as E
from custlytics.operators import rfm as R
from custlytics.operators import views as V
from custlytics.sources import testdata as TD


def test_cohort_identities(spark):
    tx = TD.transactions(spark, SF01, lines=False)
    ret = C.cohort_retention(tx, sort=False)
    assert ret.where(F.col("cohort_index") == 1).where(F.col("retention_rate") != 1.0).count() == 0
    sizes = ret.where(F.col("cohort_index") == 1).agg(F.sum("cohort_size")).first()[0]
    assert sizes == tx.select("customer_id").distinct().count()
    assert ret.where(F.col("retention_rate") > 1.0).count() == 0


def test_segment_sizes_sum_to_customers(spark):
    seg = R.rfm_segments(TD.transactions(spark, SF01, lines=False))
    n = seg.count()
    assert R.segment_summary(seg).agg(F.sum("customers")).first()[0] == n
    # every score is 1..4 and the quartile bins are as equal as the ranks allow
    for c in ("f_score", "m_score"):
        counts = [r["count"] for r in seg.groupBy(c).count().collect()]
        assert max(counts) - min(counts) <= 1


def test_rounded_and_unrounded_churn_agree_within_a_cent(spark):
    tx = TD.transactions(spark, SF01)
    a = E.customer_churn(tx, sort=False)
    b = E.customer_churn(tx, rounded=False, sort=False).select(
        "customer_id", *[F.col(c).alias(f"{c}_raw") for c in ("total_spend", "avg_order_value", "clv_proxy")])
    j = a.join(b, "customer_id")
    worst = j.agg(*[F.max(F.abs(F.col(c) - F.col(f"{c}_raw"))).alias(c)
                    for c in ("total_spend", "avg_order_value")]).first()
    assert worst.total_spend < 0.005 + 1e-6 and worst.avg_order_value <= 0.005 + 1e-6
    # CLV differs only through AOV rounding: at most n * months / 12 * half a cent
    bound = j.select((F.abs(F.col("clv_proxy") - F.col("clv_proxy_raw"))
                      - (F.col("total_transactions") * F.col("active_months") / 12 * 0.005 + 0.01))
                     .alias("excess")).agg(F.max("excess")).first()[0]
    assert bound <= 1e-9


def test_churn_label_counts_match_inactivity(spark):
    churn = E.customer_churn(TD.transactions(spark, SF01), sort=False)
    assert churn.where((F.col("churn_label") == 1) != (F.col("days_since_last_purchase") > 90)).count() == 0
    assert churn.where((F.col("churn_label") == 0) & (F.col("transactions_last_90_days") == 0)).count() == 0


def test_approx_box_stats_close_to_exact(spark):
    pred = V.churn_scores(E.customer_model_base(TD.transactions(spark, SF01)))
    exact = {r.segment: r for r in V.box_stats(pred, "churn_probability").collect()}
    approx = {r.segment: r for r in V.box_stats(pred, "churn_probability", approx=True).collect()}
    for seg, e in exact.items():
        a = approx[seg]
        assert (a.n, a.min, a.max) == (e.n, e.min, e.max)
        assert abs(a.median - e.median) < 0.05
