"""Transaction table schema and column roles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Raw transaction schema (one row per purchase).  Dates arrive as text in CSV
# and are parsed with try_to_timestamp at ingest so bad values become nulls.
TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("transaction_date", T.StringType()),
    T.StructField("order_value", T.DoubleType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("product_category", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("discount_used_pct", T.DoubleType()),
    T.StructField("customer_profile_segment", T.StringType()),
    T.StructField("customer_city", T.StringType()),
    T.StructField("customer_state", T.StringType()),
    T.StructField("signup_date", T.StringType()),
])


@dataclass(frozen=True)
class TxCols:
    """Column roles of a transaction fact table; every operator takes one so
    any fact table can be analysed without renaming."""

    id: str = "transaction_id"
    customer: str = "customer_id"
    date: str = "transaction_date"
    value: str = "order_value"
    quantity: str = "quantity"
    discount: str = "discount_used_pct"
    channel: str = "channel"
    category: str = "product_category"
    state: str = "customer_state"


TX = TxCols()

# ---- fixed values (must equal the reference for identical results) --------
# Model features that do not reveal the churn rule, and the label.
FEATURES = (
    "frequency", "monetary", "f_score", "m_score", "total_transactions",
    "total_spend", "avg_order_value", "active_months", "quantity_total",
    "discount_usage_rate", "customer_lifespan_days", "clv_proxy",
)
LABEL = "churn_label"
