"""Transaction views over the TPC-H-style test tables.

Order grain: one order = one transaction.  The per-order line aggregate is
joined only when a caller asks for quantity/discount, and geography only
when it asks for the customer's state, so scans read just the columns the
query needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlytics.plans.broadcast import broadcast_if_small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order quantity and mean discount (one row per order with lines)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("transaction_id")).agg(
        F.sum("l_quantity").cast("bigint").alias("quantity"),
        F.round(F.avg("l_discount"), 6).alias("discount_used_pct"),
    )


def customer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer key -> nation name (the nation dimension is tiny: broadcast)."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("_nk"))
    n = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("_nk"), F.col("n_name").alias("customer_state"))
    return c.join(broadcast_if_small(n, max_rows=10_000), "_nk", "left").drop("_nk")


def transactions(spark: SparkSession, sf_dir: str, *, lines: bool = True,
                 geo: bool = False) -> DataFrame:
    """Order-grain transactions.  An order key that repeats (what the
    duplicate check looks for) is left to Spark's skew join."""
    o = table(spark, sf_dir, "orders")
    tx = o.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("transaction_date"),
        F.col("o_totalprice").alias("order_value"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_orderstatus").alias("payment_method"),
    )
    if lines:
        # Both sides end up hash-partitioned on the order key: the line
        # aggregate's own exchange is reused by the join.
        per_order = order_lines(spark, sf_dir)
        tx = tx.join(per_order, "transaction_id", "left")
    if geo:
        tx = tx.join(customer_states(spark, sf_dir), "customer_id", "left")
    return tx


def line_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line grain: one row per order line with its product category.

    The composite id ``(l_orderkey, l_linenumber)`` is not unique in the test
    data, which makes this the positive case for the duplicate-id check."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_id"),
    )


def purchase_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases from the event stream table (timestamps with time of day)."""
    ev = table(spark, sf_dir, "events")
    return ev.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("transaction_date"),
        F.col("value").alias("order_value"),
    )
