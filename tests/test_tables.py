"""Replaceable tables, the layout by customer, sketches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from custlytics.operators import cohort as C
from custlytics.operators import customer as E
from custlytics.operators import quality as Q
from custlytics.operators import rfm as R
from custlytics.sources import tables as TB

SCHEMA = "transaction_id long, customer_id long, transaction_date timestamp_ntz, order_value double, quantity long"


def frame(spark, n=300, start=0):
    return spark.createDataFrame([(start + i, i % 40 if i % 9 else None, dt.datetime(2024, 1 + i % 12, 3), float(i % 7), i % 5 or None)
                                  for i in range(n)], SCHEMA)


def ids(df):
    return sorted(r.transaction_id for r in df.select("transaction_id").collect())


def test_replace_and_counts(spark, tmp_out):
    told = TB.replace_table(frame(spark), f"{tmp_out}/t")
    assert told.rows == 300 and told.nulls["customer_id"] == 34 and told.nulls["quantity"] == 60
    assert told.non_positive == {"order_value": 43, "quantity": 0} and told.first == "2024-01-03" and told.last == "2024-12-03"
    assert ids(TB.load_table(spark, f"{tmp_out}/t")) == list(range(300))
    TB.replace_table(frame(spark, 50, 1000), f"{tmp_out}/t")
    assert ids(TB.load_table(spark, f"{tmp_out}/t")) == list(range(1000, 1050))


def test_failed_write_leaves_the_old_table(spark, tmp_out):
    TB.replace_table(frame(spark), f"{tmp_out}/t")
    now = TB.current_version(spark, f"{tmp_out}/t")
    broken = frame(spark, 400).repartition(6).withColumn("order_value", F.when(F.col("transaction_id") == 333, F.raise_error(F.lit("stop"))).otherwise(F.col("order_value")))
    with pytest.raises(Exception, match="stop"):
        TB.replace_table(broken, f"{tmp_out}/t")
    assert TB.current_version(spark, f"{tmp_out}/t") == now
    assert ids(TB.load_table(spark, f"{tmp_out}/t")) == list(range(300))
    TB.replace_table(frame(spark, 20), f"{tmp_out}/t")
    assert ids(TB.load_table(spark, f"{tmp_out}/t")) == list(range(20))


def test_table_replaced_from_itself_and_readers_at_work(spark, tmp_out):
    TB.replace_table(frame(spark), f"{tmp_out}/t")
    reader = TB.load_table(spark, f"{tmp_out}/t")
    TB.replace_table(reader.where("transaction_id < 10").drop("order_month"), f"{tmp_out}/t")
    assert ids(TB.load_table(spark, f"{tmp_out}/t")) == list(range(10))
    assert reader.count() == 300                             # the version it reads is still there
    for n in (5, 6, 7):
        TB.replace_table(frame(spark, n), f"{tmp_out}/t")
    assert len(TB._Files(spark, f"{tmp_out}/t").versions()) == 2


def test_empty_table(spark, tmp_out):
    told = TB.replace_table(frame(spark).where("false"), f"{tmp_out}/t")
    assert told.rows == 0 and told.first is None
    with pytest.raises(FileNotFoundError):
        TB.load_table(spark, f"{tmp_out}/none")


OPERATORS = {
    "rfm": lambda t: R.rfm(t, as_of="2024-12-31", sort=False), "first_purchase": C.first_purchase,
    "customer_base": lambda t: E.customer_base(t, sort=False), "customer_churn": lambda t: E.customer_churn(t, sort=False),
    "one_time": Q.one_time_customers, "repeat": Q.repeat_customers,
}


@pytest.fixture(scope="module")
def by_customer(spark, tmp_path_factory):
    table = TB.write_by_customer(frame(spark), "by_customer_test", 4, str(tmp_path_factory.mktemp("bucketed") / "t"))
    yield table
    spark.sql("DROP TABLE by_customer_test")


@pytest.mark.parametrize("name", OPERATORS)
def test_no_exchange_on_the_customer(spark, by_customer, name):
    out = OPERATORS[name](by_customer)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(customer_id" not in plan and "SinglePartition" in plan or "Exchange" not in plan
    assert sorted(map(repr, out.collect())) == sorted(map(repr, OPERATORS[name](frame(spark)).collect()))


def test_sketches_merge(spark):
    tx = spark.range(20_000).select(F.col("id").alias("transaction_id"), (F.col("id") % 5003).alias("customer_id"),
                                    F.expr("make_timestamp_ntz(2024, 1 + cast(id % 12 as int), 1, 0, 0, 0)").alias("transaction_date"),
                                    F.expr("id div 12 % 3").alias("store"))
    s = TB.customer_sketches(tx, ("store",))
    for first, last in ((None, None), ("2024-03", "2024-04"), ("2024-12", None)):
        month = F.date_format("transaction_date", "yyyy-MM")
        rows = tx.where((month >= (first or "0")) & (month <= (last or "9")))
        got = TB.customers_between(s, first, last).first()
        exact = rows.select("customer_id").distinct().count()
        assert got.rows == rows.count() and abs(got.customers - exact) <= TB.sketch_error() * exact
        per = {r.store: r.customers for r in TB.customers_between(s, first, last, ("store",)).collect()}
        assert set(per) == {0, 1, 2} and all(v > 0 for v in per.values())
