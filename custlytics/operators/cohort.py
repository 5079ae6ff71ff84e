"""Monthly cohort retention.

Plan: the transactions are reduced to each customer's set of active
months in one partially aggregated shuffle (the set is bounded by the
number of calendar months, so a customer with a third of all rows ships a
handful of month keys per task); the cohort is the set's minimum, and the
cohort cells are a count over one row per (customer, active month)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custlytics.functions.dates import day, month_key, month_label
from custlytics.functions.money import from_micros, half_up_div
from custlytics.operators.customer import month_aggs, month_list
from custlytics.operators.rfm import customers_only, dataset_span
from custlytics.plans.skew import hot_keys_by_count, salted_left_join
from custlytics.session import materialize
from custlytics.schemas import TX, TxCols


def with_order_month(tx: DataFrame, cols: TxCols = TX) -> DataFrame:
    """``order_month`` text (yyyy-MM) of each transaction."""
    return tx.withColumn("order_month", month_label(month_key(cols.date)))


def first_purchase(tx: DataFrame, cols: TxCols = TX) -> DataFrame:
    """First purchase date and cohort month per customer."""
    return (customers_only(tx, cols).groupBy(F.col(cols.customer).alias("customer_id"))
            .agg(F.min(day(cols.date)).alias("first_purchase_date"))
            .withColumn("cohort_month", month_label(month_key("first_purchase_date"))))


def cohort_assign(tx: DataFrame, cols: TxCols = TX, hot_share: float = 0.01) -> DataFrame:
    """D3: every transaction with its customer's cohort and 1-based month index.

    The per-customer first month (with the customer's row count) is a
    partial aggregation, materialised once.  Customers holding at least
    ``hot_share`` of all rows -- at most ``1/hot_share`` of them -- have
    their transactions salted across all shuffle partitions for the join
    back; everyone else takes the plain shuffle join.  Rows without a date
    have no month and no index."""
    t = customers_only(tx, cols)
    firsts = materialize(t.groupBy(F.col(cols.customer).alias("_c")).agg(
        F.min(month_key(cols.date)).alias("_cohort"), F.count(F.lit(1)).alias("_n")))
    hot = hot_keys_by_count(firsts, "_c", "_n", hot_share)
    splits = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = salted_left_join(t, firsts.select("_c", "_cohort"), cols.customer, "_c", hot, splits,
                         salt_from=[cols.id, cols.date])
    mk = month_key(cols.date)
    return j.select(
        F.col(cols.customer).alias("customer_id"), F.col(cols.id).alias("transaction_id"),
        day(cols.date).alias("transaction_date"), month_label(mk).alias("order_month"),
        month_label("_cohort").alias("cohort_month"),
        (mk - F.col("_cohort") + 1).cast("int").alias("cohort_index"))


def customer_months(tx: DataFrame, cols: TxCols = TX) -> DataFrame:
    """Distinct (customer, month key) with the customer's cohort month key.

    One partially aggregated shuffle on the customer: a customer's active
    months are bits of one integer or a few, whatever the number of
    transactions, so a customer with a third of all rows ships a few bytes a
    task; the cohort is the first bit.  Activity without a date is one row
    with a null month, as in ``cohort_assign``."""
    undated = F.bool_or(day(cols.date).isNull())
    lo, hi = dataset_span(tx, cols)
    per = customers_only(tx, cols).groupBy(F.col(cols.customer).alias("customer_id")).agg(
        *month_aggs(cols.date, lo, hi), undated.alias("_undated")).select("customer_id", "_undated", month_list(lo, hi).alias("_ms"))
    months = F.when(F.col("_undated"), F.array_append("_ms", F.lit(None).cast("int"))).otherwise(F.col("_ms"))
    return per.select("customer_id", F.explode(months).alias("_m"), F.array_min("_ms").alias("_cohort"))


def cohort_counts(tx: DataFrame, cols: TxCols = TX) -> DataFrame:
    """Distinct active customers per (cohort month, month index)."""
    cm = customer_months(tx, cols)
    return (cm.groupBy("_cohort", (F.col("_m") - F.col("_cohort") + 1).cast("int").alias("cohort_index"))
            .agg(F.count(F.lit(1)).alias("customers"))
            .select(month_label("_cohort").alias("cohort_month"), "cohort_index", "customers"))


def cohort_size(counts: DataFrame) -> DataFrame:
    """Size of each cohort = its month-1 count."""
    return counts.where(F.col("cohort_index") == 1).select(
        "cohort_month", F.col("customers").alias("cohort_size"))


def retention_rate(customers, size, decimals: int = 4):
    """customers / size rounded half-up from exact integers (null for size 0)."""
    c = F.col(customers) if isinstance(customers, str) else customers
    s = F.col(size) if isinstance(size, str) else size
    scaled = half_up_div(c.cast("decimal(38,0)") * (10 ** decimals), s)
    return F.when(s > 0, from_micros(scaled, 10 ** decimals))


def cohort_retention(tx: DataFrame, cols: TxCols = TX, sort: bool = True) -> DataFrame:
    """cohort_month, cohort_index, customers, cohort_size, retention_rate.

    The cohort size is taken with a window over the (tiny) cell table instead
    of a self-join; cells with no activity stay absent."""
    counts = cohort_counts(tx, cols)
    w = Window.partitionBy("cohort_month")
    out = (counts.withColumn("cohort_size",
                             F.max(F.when(F.col("cohort_index") == 1, F.col("customers"))).over(w))
           .withColumn("retention_rate", retention_rate("customers", "cohort_size")))
    return out.orderBy("cohort_month", "cohort_index") if sort else out


def filter_cohorts(ret: DataFrame, max_index: int | None = 12,
                   cohorts: Iterable[str] | None = None) -> DataFrame:
    """Keep the first ``max_index`` months and the chosen cohorts."""
    out = ret
    if max_index is not None:
        out = out.where(F.col("cohort_index") <= max_index)
    if cohorts is not None:
        out = out.where(F.col("cohort_month").isin(list(cohorts)))
    return out


def cohort_options(ret: DataFrame) -> DataFrame:
    """Sorted distinct cohort months (the choices of a cohort picker)."""
    return ret.select("cohort_month").distinct().orderBy("cohort_month")


def latest_retention(ret: DataFrame) -> DataFrame:
    """The latest observed cell of each cohort, highest retention first."""
    latest = ret.groupBy("cohort_month").agg(
        F.max_by(F.struct("cohort_index", "customers", "cohort_size", "retention_rate"),
                 F.col("cohort_index")).alias("r"))
    return (latest.select("cohort_month", "r.*")
            .orderBy(F.desc("retention_rate"), F.asc("cohort_month")))


def cohort_matrix(ret: DataFrame, indexes: Sequence[int] = tuple(range(1, 13)),
                  value: str = "retention_rate") -> DataFrame:
    """Wide cohort x month-index matrix (explicit pivot values, so no
    extra job to discover them); silent months are null."""
    wide = ret.groupBy("cohort_month").pivot("cohort_index", list(indexes)).agg(F.max(value))
    return wide.select("cohort_month", *[F.col(str(i)).alias(f"month_{i}") for i in indexes]) \
               .orderBy("cohort_month")
