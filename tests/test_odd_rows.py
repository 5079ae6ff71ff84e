"""Null dates, a customer without any date, null ids and money of three
decimals: every operator of the customer analyses against DuckDB SQL over the
same fixture."""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from custlytics import oracle as O
from custlytics.operators import cohort as C
from custlytics.operators import customer as E
from custlytics.operators import ml as M
from custlytics.operators import rfm as R
from custlytics.operators import views as V
from custlytics.session import materialize
from tools.oracle_check import digest

SCHEMA = ("transaction_id long, customer_id long, transaction_date timestamp_ntz, order_value double, channel string, "
          "payment_method string, quantity bigint, discount_used_pct double")


def rows():
    rng = random.Random(9)
    out, tid = [], 0
    for customer in range(1, 41):
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            tid += 1
            day = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(500), hours=rng.randrange(24))
            out.append((tid, customer, day if rng.random() > 0.15 else None, rng.choice([10.005, 0.015, 99.995, 3.333, 120.0]),
                        rng.choice(["web", "app", None]), "card", rng.choice([1, 2, None]), rng.choice([0.0, 0.125, 0.333333, None])))
    for customer in (50, 51):                                # no date at all
        out += [(tid + customer + k, customer, None, 10.005, "web", "card", 1, None) for k in range(2)]
    out.append((9001, None, dt.datetime(2024, 5, 1), 5.0, "web", "card", 1, 0.0))
    out.append((9002, 52, dt.datetime(2024, 5, 1), None, "web", "card", None, None))
    out += [(9100, 53, dt.datetime(2025, 5, 15), 10.005, "web", "card", 1, 0.5), (9101, 53, dt.datetime(2025, 5, 15), 10.005, "web", "card", 1, 0.5)]
    return out


@pytest.fixture(scope="module")
def tx(spark):
    return materialize(spark.createDataFrame(rows(), SCHEMA))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    pdf = pd.DataFrame(rows(), columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype(
        {"transaction_id": "Int64", "customer_id": "Int64", "quantity": "Int64"})
    pdf["transaction_date"] = pd.to_datetime(pdf["transaction_date"])
    c.register("pdf", pdf)
    c.execute("CREATE TABLE fixture AS SELECT * REPLACE (CAST(quantity AS BIGINT) AS quantity) FROM pdf")
    return c


def _pred(tx):
    base = materialize(E.customer_features(tx))
    most = base.agg(F.max("days_since_last_purchase")).first()[0]
    return materialize(V.churn_scores(E.customer_model_base(None, features=base), max_days=most))


def _split(tx):
    return M.stratified_split(materialize(E.customer_churn(tx, sort=False).select("customer_id", "churn_label")))


CASES = {
    "rfm": R.rfm, "rfm_segments": R.rfm_segments, "segment_summary": lambda t: R.segment_summary(R.rfm_segments(t), decimals=6),
    "first_purchase": C.first_purchase, "cohort_assign": C.cohort_assign, "cohort_counts": C.cohort_counts,
    "cohort_size": lambda t: C.cohort_size(C.cohort_counts(t)), "cohort_retention": C.cohort_retention,
    "cohort_latest": lambda t: C.latest_retention(C.filter_cohorts(C.cohort_retention(t), 12)),
    "cohort_matrix": lambda t: C.cohort_matrix(C.filter_cohorts(C.cohort_retention(t), 12)),
    "customer_churn": E.customer_churn, "customer_churn_unrounded": lambda t: E.customer_churn(t, rounded=False),
    "recent_activity": E.recent_activity, "churn_distribution": lambda t: R.value_counts(E.customer_churn(t), "churn_label", "customers"),
    "model_base": E.customer_model_base, "model_features": lambda t: M.assemble_features(E.customer_model_base(t)),
    "stratified_split": _split, "class_weight": lambda t: M.class_weight(_split(t).where("split = 'train'")),
    "kpi_row": lambda t: V.kpis(_pred(t), decimals=6), "segment_performance": lambda t: V.segment_performance(_pred(t), decimals=6),
    "risk_summary": lambda t: V.risk_summary(_pred(t), decimals=6), "prob_histogram": lambda t: V.histogram(_pred(t)),
    "box_clv": lambda t: V.box_stats(_pred(t), "clv_proxy", decimals=6),
    "box_churn_probability": lambda t: V.box_stats(_pred(t), "churn_probability", decimals=6),
    "risk_band": lambda t: V.with_risk_band(_pred(t)).select("customer_id", "churn_probability", "risk_band"),
    "top_risk": lambda t: V.top_n(_pred(t), "churn_probability", 25, cols=V.TOP_COLUMNS),
    "dq_null_counts": None, "dq_date_range": None,
}


@pytest.mark.parametrize("name", [n for n, f in CASES.items() if f])
def test_equals_sql(tx, con, name):
    df = CASES[name](tx)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(O.ORACLE[name].replace(O.TX, "tx AS (SELECT * FROM fixture)"))
    want = cur.fetchall()
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names) and len(got) == len(want)
    a, b = digest(df.columns, got), digest(names, want)
    assert a[0] == b[0], (sorted(set(a[1]) - set(b[1]))[:3], sorted(set(b[1]) - set(a[1]))[:3])


def test_customer_without_dates(tx):
    r = {r.customer_id: r for r in E.customer_churn(tx).collect()}
    assert r[50].churn_label == 0 and r[50].days_since_last_purchase is None and r[50].total_spend == 20.01
    assert r[53].total_spend == 20.01 and r[53].avg_order_value == 10.01


def test_cohort_cells_hold_every_assigned_row(tx):
    assigned = {(r.cohort_month, r.cohort_index) for r in C.cohort_assign(tx).select("cohort_month", "cohort_index").collect()}
    cells = {(r.cohort_month, r.cohort_index) for r in C.cohort_counts(tx).collect()}
    assert assigned == cells and (None, None) in cells and any(m and i is None for m, i in cells)
    assert {r.order_month for r in C.with_order_month(tx).where("transaction_date IS NULL").collect()} == {None}


def test_box_keeps_a_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0), ("b", None)], "segment string, v double")
    got = {r.segment: (r.n, r.median) for r in V.box_stats(df, "v").collect()}
    assert got == {"a": (2, 2.0), None: (2, 6.0)}


def test_null_labels_are_not_split(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 2) for i in range(200)], "customer_id long, churn_label int")
    s = M.stratified_split(df).collect()
    assert all((r.split is None) == (r.churn_label is None) for r in s)
    n = sum(r.churn_label is not None for r in s)
    assert sum(r.split == "test" for r in s) == -(-n // 5)


def test_auc_of_counts_past_64_bits(spark):
    # 3e9 x 3e9 pairs: the denominator leaves 64 bits
    df = spark.createDataFrame([(0.9, 3_000_000_000, 0), (0.1, 0, 3_000_000_000)], "s double, p long, n long")
    out = M.auc_of_counts(df, "s", "p", "n").first()
    assert out.roc_auc == 1.0 and out.positives == out.negatives == 3_000_000_000


def test_money_is_rounded_from_the_true_sum(spark):
    """Amounts of six decimals against ROUND(SUM(x), 2)."""
    rng = random.Random(3)
    rows = [(i, i % 7, dt.datetime(2024, 1 + i % 5, 3), amount, 1, 0.1) for i, amount in enumerate(
        [0.00004] * 700 + [rng.choice([0.000049, 1.234567, 123456.789012, 0.005, 1e-6]) for _ in range(700)])]
    tx = spark.createDataFrame(rows, "transaction_id long, customer_id long, transaction_date timestamp_ntz, order_value double, quantity long, discount_used_pct double")
    pdf = pd.DataFrame(rows, columns=["id", "c", "d", "v", "q", "p"])
    want = duckdb.sql("SELECT c, CAST(ROUND(SUM(CAST(v AS DECIMAL(30,6))), 2) AS DOUBLE) FROM pdf GROUP BY c ORDER BY c").fetchall()
    assert len(pdf) == 1400 and [(r.customer_id, r.monetary) for r in R.rfm(tx).orderBy("customer_id").collect()] == want
    assert [(r.customer_id, r.total_spend) for r in E.customer_churn(tx).collect()] == want
    small = spark.createDataFrame([(i, 1, dt.datetime(2024, 1, 1), 0.00004) for i in range(1000)], "transaction_id long, customer_id long, transaction_date timestamp_ntz, order_value double")
    assert R.rfm(small).first().monetary == 0.04


def test_sums_past_64_bits(spark):
    big = spark.createDataFrame([(i, 1, dt.datetime(2024, 1, 1), 9e15) for i in range(3000)], "transaction_id long, customer_id long, transaction_date timestamp_ntz, order_value double")
    assert R.rfm(big).first().monetary == 2.7e19


def test_months_as_bits(spark):
    """Months over many integers, and a span too long for them, against sets."""
    rng = random.Random(8)
    days = [dt.datetime(1990 + rng.randrange(30), rng.randrange(1, 13), 5) for _ in range(400)]
    schema = "transaction_id long, customer_id long, transaction_date timestamp_ntz, order_value double"
    for extra in ([], [dt.datetime(1, 1, 1), dt.datetime(9000, 6, 1)]):
        rows = [(i, i % 9, d, 1.0) for i, d in enumerate([*days, *extra, None])]
        tx = spark.createDataFrame(rows, schema)
        want = {}
        for _, c, d, _ in rows:
            want.setdefault(c, set())
            if d:
                want[c].add((d.year, d.month))
        assert {r.customer_id: r.active_months for r in E.customer_churn(tx).collect()} == {c: len(m) for c, m in want.items()}
        assert C.customer_months(tx).where("_m IS NOT NULL").count() == sum(map(len, want.values()))
    plan = E.customer_churn(spark.createDataFrame([(1, 1, days[0], 1.0)], schema), sort=False)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
