import datetime as dt

from pyspark.sql import types as T

TX_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("transaction_date", T.TimestampNTZType()),
    T.StructField("order_value", T.DoubleType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("discount_used_pct", T.DoubleType()),
    T.StructField("channel", T.StringType()),
])


def d(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def make_tx(spark, rows):
    """rows: (id, customer, 'YYYY-MM-DD[ HH:MM]', value[, qty[, disc[, channel]]])"""
    full = []
    for r in rows:
        r = list(r) + [None] * (7 - len(r))
        tid, cust, date, value, qty, disc, ch = r
        full.append((tid, cust, d(date) if isinstance(date, str) else date, value,
                     1 if qty is None else qty, 0.0 if disc is None else disc, ch or "web"))
    return spark.createDataFrame(full, TX_SCHEMA)
