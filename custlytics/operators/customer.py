"""Customer metrics, churn label and lifetime-value proxy.

``customer_churn`` is one aggregation per customer: the trailing-window
activity is a conditional count/sum in the same pass (equivalent to the
CROSS JOIN + LEFT JOIN + COALESCE formulation), and the dataset end date is
a literal.  Money and rates are summed exactly, and every figure is rounded
half-up once, from the sum.  Active months are bits of one integer or a few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlytics.functions.dates import MOST_WORDS, WORD_MONTHS, count_months, day, month_key, month_words, months_of
from custlytics.functions.money import SCALE, from_cents, from_micros, half_up_div, total_units, units_to_cents
from custlytics.operators.rfm import as_of_column, customers_only, dataset_span, on_or_after, score_customers
from custlytics.schemas import TX, TxCols

INACTIVITY_DAYS = 90
CLV_MONTHS = 12
#: What the model base adds to the churn table.
SCORE_COLUMNS = ("recency", "frequency", "monetary", "r_score", "f_score", "m_score", "rfm_score", "segment")


def churn_label(days_since: Column | str = "days_since_last_purchase",
                days: int = INACTIVITY_DAYS) -> Column:
    """1 when the customer has been silent for more than ``days``, else 0
    (also when no date of the customer is known)."""
    c = F.col(days_since) if isinstance(days_since, str) else days_since
    return F.when(c > days, 1).otherwise(0)


def clv_cents(n: Column, aov_cents: Column, active_months: Column, months: int = CLV_MONTHS) -> Column:
    """Transactions x AOV x active_months / months, in cents (half-up)."""
    return half_up_div(n.cast("decimal(38,0)") * aov_cents * active_months, F.lit(months))


def _role(tx: DataFrame, name: str, dtype: str) -> Column:
    """A role column, or a typed null when the fact table lacks it."""
    return F.col(name) if name in tx.columns else F.lit(None).cast(dtype)


def month_range(lo, hi) -> tuple[int, int]:
    """Month keys of two dates (of none: an empty year)."""
    return (0, 0) if lo is None else (lo.year * 12 + lo.month - 1, hi.year * 12 + hi.month - 1)


def month_aggs(date: str, lo, hi) -> list[Column]:
    """The aggregates from which :func:`active_months` counts months.

    Bits of 64-bit integers, one for every 63 months of the data; dates that
    span more than MOST_WORDS such integers (two centuries: a mistyped year)
    are collected as a set of month keys instead."""
    first, last = month_range(lo, hi)
    if (last - first) // WORD_MONTHS < MOST_WORDS:
        return [w.alias(f"_months{i}") for i, w in enumerate(month_words(date, first, last))]
    return [F.collect_set(month_key(date)).alias("_months")]


def active_months(lo, hi) -> Column:
    """Distinct calendar months, from :func:`month_aggs`."""
    first, last = month_range(lo, hi)
    words = (last - first) // WORD_MONTHS + 1
    return count_months([F.col(f"_months{i}") for i in range(words)]) if words <= MOST_WORDS else F.size("_months")


def month_list(lo, hi) -> Column:
    """The month keys themselves, from :func:`month_aggs`."""
    first, last = month_range(lo, hi)
    words = (last - first) // WORD_MONTHS + 1
    return months_of([F.col(f"_months{i}") for i in range(words)], first, last) if words <= MOST_WORDS else F.col("_months")


def _base_aggs(tx: DataFrame, cols: TxCols, end: Column, days: int, lo, hi) -> list[Column]:
    d = day(cols.date)
    recent = d >= F.date_sub(end, days)
    qty = _role(tx, cols.quantity, "bigint")
    disc = _role(tx, cols.discount, "double")
    return [
        F.min(d).alias("first_purchase_date"),
        F.max(d).alias("last_purchase_date"),
        F.count(cols.id).alias("total_transactions"),
        total_units(cols.value).alias("_units"),
        F.count(cols.value).alias("_nvalue"),
        F.sum(qty).cast("bigint").alias("quantity_total"),
        total_units(disc).alias("_disc"),
        F.count(disc).alias("_ndisc"),
        *month_aggs(cols.date, lo, hi),
        F.count(F.when(recent, F.col(cols.id))).alias("transactions_last_90_days"),
        total_units(F.when(recent, F.col(cols.value))).alias("_recent"),
    ]


def customer_churn(tx: DataFrame, cols: TxCols = TX, rounded: bool = True, as_of=None,
                   inactivity_days: int = INACTIVITY_DAYS, sort: bool = True) -> DataFrame:
    """The customer churn table.

    ``rounded=True`` rounds spend, AOV and discount first and derives CLV from
    the rounded AOV; ``rounded=False`` keeps them unrounded and only rounds
    CLV (the two formulations of the reference)."""
    lo, hi = dataset_span(tx, cols)
    end = F.lit(hi if as_of is None else as_of).cast("date")
    g = customers_only(tx, cols).groupBy(F.col(cols.customer).alias("customer_id")).agg(
        *_base_aggs(tx, cols, end, inactivity_days, lo, hi)).withColumn("active_months", active_months(lo, hi).cast("bigint"))
    n = F.col("total_transactions")
    unit = 10 ** SCALE
    if rounded:
        spend = from_cents(units_to_cents("_units"))
        aov_c = half_up_div("_units", F.col("_nvalue").cast("decimal(20,0)") * (unit // 100))
        aov = from_cents(aov_c)
        disc = F.when(F.col("_ndisc") > 0,
                      from_micros(half_up_div("_disc", F.col("_ndisc").cast("decimal(20,0)") * (unit // 10000)), 10000))
        clv = from_cents(clv_cents(n, aov_c, F.col("active_months")))
    else:
        # unrounded: exact integer sums divided once (a correctly rounded
        # double, independent of summation order); only CLV is rounded
        spend = F.col("_units").cast("double") / unit
        aov = F.col("_units").cast("double") / (F.col("_nvalue").cast("decimal(20,0)") * unit).cast("double")
        disc = F.col("_disc").cast("double") / (F.col("_ndisc").cast("decimal(20,0)") * unit).cast("double")
        clv = from_cents(half_up_div(F.col("_units") * n * F.col("active_months"),
                                     F.col("_nvalue").cast("decimal(20,0)") * (CLV_MONTHS * unit // 100)))
    days_since = F.datediff(end, F.col("last_purchase_date"))
    out = g.select(
        "customer_id", "first_purchase_date", "last_purchase_date", "total_transactions",
        spend.alias("total_spend"), aov.alias("avg_order_value"), "quantity_total",
        disc.alias("discount_usage_rate"), F.col("active_months").cast("bigint").alias("active_months"),
        F.datediff("last_purchase_date", "first_purchase_date").alias("customer_lifespan_days"),
        days_since.alias("days_since_last_purchase"),
        churn_label(days_since, inactivity_days).alias("churn_label"),
        clv.alias("clv_proxy"),
        F.col("transactions_last_90_days").cast("bigint").alias("transactions_last_90_days"),
        from_cents(F.coalesce(units_to_cents("_recent"), F.lit(0))).alias("spend_last_90_days"),
    )
    return out.orderBy("customer_id") if sort else out


def customer_base(tx: DataFrame, cols: TxCols = TX, **kw) -> DataFrame:
    """E2 (with E3 active months): the base aggregates per customer."""
    return customer_churn(tx, cols, **kw).select(
        "customer_id", "first_purchase_date", "last_purchase_date", "total_transactions",
        "total_spend", "avg_order_value", "quantity_total", "discount_usage_rate", "active_months")


def recent_activity(tx: DataFrame, cols: TxCols = TX, days: int = INACTIVITY_DAYS,
                    as_of=None) -> DataFrame:
    """Customers active in the trailing ``days`` (inclusive) with their
    count and spend there."""
    end = as_of_column(tx, as_of, cols)
    t = customers_only(tx, cols).where(on_or_after(tx, cols.date, F.date_sub(end, days)))
    return t.groupBy(F.col(cols.customer).alias("customer_id")).agg(
        F.count(cols.id).alias("transactions_last_90_days"),
        from_cents(units_to_cents(total_units(cols.value))).alias("spend_last_90_days"))


def model_base(churn: DataFrame, rfm: DataFrame, segments: DataFrame) -> DataFrame:
    """E9 (join form): churn table + RFM + scores/segment on the customer."""
    seg = segments.select("customer_id", "r_score", "f_score", "m_score", "rfm_score", "segment")
    return (churn.join(rfm.select("customer_id", "recency", "frequency", "monetary"), "customer_id", "left")
            .join(seg, "customer_id", "left"))


def customer_features(tx: DataFrame, cols: TxCols = TX, rfm_as_of=None, **kw) -> DataFrame:
    """The churn table with its RFM columns, from one aggregation: frequency
    and spend are the churn table's own, and recency counts from
    ``rfm_as_of`` (a fixed report date) or, by default, from the same end."""
    churn = customer_churn(tx, cols, sort=False, **kw)
    recency = (F.col("days_since_last_purchase") if rfm_as_of is None
               else F.datediff(F.lit(rfm_as_of).cast("date"), F.col("last_purchase_date")))
    return churn.withColumns({"recency": recency, "frequency": F.col("total_transactions"), "monetary": F.col("total_spend")})


def customer_model_base(tx: DataFrame, cols: TxCols = TX, features: DataFrame | None = None,
                        as_of=None, rfm_as_of=None, **kw) -> DataFrame:
    """E9 (fused form): features plus scores and segment, without a join.
    ``as_of`` anchors churn, ``rfm_as_of`` recency; pass ``features`` when
    they are already materialised."""
    if features is not None:
        return score_customers(features, materialized=True, **kw)
    return score_customers(customer_features(tx, cols, rfm_as_of=rfm_as_of, as_of=as_of), **kw)
