"""Analyst views over the scored customer table.

``pred`` has one row per customer with at least ``customer_id, segment,
churn_label, churn_probability, clv_proxy, frequency, monetary``.  Every
view is a DataFrame: filters push down to the scan, top-N lists plan as
``TakeOrderedAndProject`` (no full sort), quantiles are located by counting,
and small dimension tables (risk bands) are broadcast by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlytics.functions.binning import band, fixed_bin
from custlytics.functions.money import cents, exact_mean
from custlytics.operators.rank import exact_quantiles
from custlytics.plans.broadcast import broadcast_if_small
from custlytics.schemas import FEATURES
from custlytics.session import materialize

# ---- fixed values (must equal the reference for identical results) --------
RISK_EDGES = (0.0, 0.3, 0.7, 1.0)
RISK_LABELS = ("Low Risk", "Medium Risk", "High Risk")
HIGH_RISK_THRESHOLD = 0.7        # the KPI counts p >= 0.7 (the band starts above 0.7)
HISTOGRAM_BINS = 30
TOP_N = 25
SEGMENT_METRICS = ("customers", "avg_churn_probability", "avg_clv_proxy", "avg_frequency",
                   "avg_monetary")
TABLE_SORT_COLUMNS = ("churn_probability", "clv_proxy", "frequency", "monetary")
TOP_COLUMNS = ("customer_id", "segment", "churn_probability", "clv_proxy", "frequency", "monetary")
# ---------------------------------------------------------------------------

PRED_COLUMNS = ("customer_id", "segment", "churn_label", "churn_probability", "clv_proxy",
                *[f for f in FEATURES if f != "clv_proxy"])


def churn_scores(model_base: DataFrame, probability: Column | None = None,
                 threshold: float = 0.5, max_days: int | None = None) -> DataFrame:
    """The scored customer table ``pred``.

    Without a model, the deterministic score ``days since last purchase /
    max days since last purchase`` stands in for the probability (it makes
    every view checkable against SQL).  The max is a one-row aggregate taken
    once and used as a literal; unless the caller passes it (taken from an
    already materialised table), the base is checkpointed first so the max
    and the views read it, not its lineage."""
    base = model_base
    if probability is None:
        if max_days is None:
            base = materialize(model_base)
            max_days = base.agg(F.max("days_since_last_purchase")).first()[0]
        probability = F.col("days_since_last_purchase").cast("double") / F.lit(max_days)
    out = base.withColumn("churn_probability", probability)
    return out.select(*PRED_COLUMNS, (F.col("churn_probability") > threshold).cast("int").alias("prediction"))


# ----------------------------------------------------------------- filters

def segment_options(pred: DataFrame) -> DataFrame:
    """G1: sorted distinct non-null segments."""
    return pred.where(F.col("segment").isNotNull()).select("segment").distinct().orderBy("segment")


def clv_bounds(pred: DataFrame) -> DataFrame:
    """CLV range and the rounded bounds of a range control."""
    return pred.agg(F.min("clv_proxy").alias("clv_min"), F.max("clv_proxy").alias("clv_max"),
                    F.round(F.min("clv_proxy"), 0).alias("slider_min"),
                    F.round(F.max("clv_proxy"), 0).alias("slider_max"))


def filter_customers(pred: DataFrame, segments: Sequence[str] | None = None,
                     prob: tuple[float, float] = (0.0, 1.0),
                     clv: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Segment membership and inclusive probability/CLV ranges.  Default
    CLV range is unbounded (rounded control bounds could drop extremes)."""
    cond = F.col("churn_probability").between(prob[0], prob[1])
    if segments is not None:
        cond = cond & F.col("segment").isin(list(segments))
    if clv[0] is not None:
        cond = cond & (F.col("clv_proxy") >= clv[0])
    if clv[1] is not None:
        cond = cond & (F.col("clv_proxy") <= clv[1])
    return pred.where(cond)


class EmptySelection(ValueError):
    pass


def require_rows(df: DataFrame) -> DataFrame:
    """Stop when the filters leave nothing (reads at most one row)."""
    if df.isEmpty():
        raise EmptySelection("No records match the selected filters.")
    return df


def risk_band(col: str = "churn_probability", edges=RISK_EDGES, labels=RISK_LABELS) -> Column:
    """Right-closed bands, lowest closed; outside -> null."""
    return band(col, edges, labels, include_lowest=True)


def with_risk_band(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_band", risk_band())


# -------------------------------------------------------------- aggregates

def _means(decimals: int | None) -> list[Column]:
    """Mean probability, CLV, frequency and spend; exact half-up when
    ``decimals`` is given (money from cents, counts from integer sums)."""
    n = F.count(F.lit(1))
    if decimals is None:
        return [F.avg("churn_probability").alias("avg_churn_probability"),
                F.avg("clv_proxy").alias("avg_clv_proxy"),
                F.avg("frequency").alias("avg_frequency"),
                F.avg("monetary").alias("avg_monetary")]
    return [F.round(F.avg("churn_probability"), decimals).alias("avg_churn_probability"),
            exact_mean(F.sum(cents("clv_proxy")), n, 2, decimals).alias("avg_clv_proxy"),
            exact_mean(F.sum("frequency"), n, 0, decimals).alias("avg_frequency"),
            exact_mean(F.sum(cents("monetary")), n, 2, decimals).alias("avg_monetary")]


def kpis(df: DataFrame, decimals: int | None = None) -> DataFrame:
    """The KPI row in one aggregation.  ``pred`` has one row per
    customer, so the distinct counts are plain counts."""
    m = _means(decimals)
    return df.agg(
        F.count("customer_id").alias("customers"), m[0], m[1],
        F.count(F.when(F.col("churn_probability") >= HIGH_RISK_THRESHOLD,
                       F.col("customer_id"))).alias("high_risk_customers"),
        m[2], m[3])


def segment_performance(df: DataFrame, decimals: int | None = None) -> DataFrame:
    """Customers and four means per segment, largest first.  ``pred`` has
    one row per customer, so the distinct count is a plain count."""
    return (df.groupBy("segment").agg(F.count(F.col("customer_id")).alias("customers"), *_means(decimals))
            .orderBy(F.desc("customers"), F.asc("segment")))


def segment_metric(perf: DataFrame, metric: str = "customers") -> DataFrame:
    """One chosen metric per segment."""
    if metric not in SEGMENT_METRICS:
        raise ValueError(f"metric must be one of {SEGMENT_METRICS}")
    return perf.select("segment", metric)


def risk_summary(df: DataFrame, decimals: int | None = None) -> DataFrame:
    """Per risk band, empty bands included (count 0, null means)."""
    spark = df.sparkSession
    bands = spark.createDataFrame([(i, b) for i, b in enumerate(RISK_LABELS)],
                                  "band_order int, risk_band string")
    m = _means(decimals)
    agg = with_risk_band(df).where(F.col("risk_band").isNotNull()).groupBy("risk_band").agg(
        F.count(F.col("customer_id")).alias("customers"), m[0], m[1])
    # one aggregate row a band: broadcast by construction
    out = bands.join(broadcast_if_small(agg, len(RISK_LABELS), proven=True), "risk_band", "left")
    return (out.select("risk_band", F.coalesce("customers", F.lit(0)).alias("customers"),
                       "avg_churn_probability", "avg_clv_proxy", "band_order")
            .orderBy("band_order").drop("band_order"))


def histogram(df: DataFrame, col: str = "churn_probability", bins: int = HISTOGRAM_BINS,
              lo: float = 0.0, hi: float = 1.0, by: str | None = "risk_band") -> DataFrame:
    """Equal-width histogram (``bins`` bins over [lo, hi]) split by ``by``."""
    d = with_risk_band(df) if by == "risk_band" and "risk_band" not in df.columns else df
    b = fixed_bin(col, lo, hi, bins)
    keys = ([by] if by else []) + [b.alias("bin")]
    out = d.where(F.col(col).between(lo, hi)).groupBy(*keys).agg(F.count(F.lit(1)).alias("customers"))
    width = float(hi - lo)
    return out.select(*([by] if by else []), "bin",
                      (F.lit(float(lo)) + F.col("bin").cast("double") * width / bins).alias("bin_lo"),
                      (F.lit(float(lo)) + (F.col("bin") + 1).cast("double") * width / bins).alias("bin_hi"),
                      "customers")


def box_stats(df: DataFrame, col: str, by: str = "segment", decimals: int | None = None,
              approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Box-plot statistics per group (a null group is one): quartiles
    (linear), min, max, 1.5 IQR whiskers and outlier count.

    Quartiles are exact and located by counting; the quartile table has one
    row per group and is broadcast behind a count of its rows, so the whiskers
    take one more aggregation and no shuffle of customers."""
    if approx:
        # one pass, bounded memory per group (a quantile sketch); quartiles
        # are then sample values within 1/accuracy in rank, not interpolated
        qs = df.groupBy(by).agg(F.percentile_approx(col, [0.25, 0.5, 0.75], accuracy).alias("_q")) \
               .select(by, *[F.col("_q")[i].cast("double").alias(f"q{i}") for i in range(3)])
    else:
        qs = exact_quantiles(df, col, (0.25, 0.5, 0.75), by=[by])
    rnd = (lambda c: F.round(c, decimals)) if decimals is not None else (lambda c: c)
    qs = qs.select(by, rnd(F.col("q0")).alias("q1"), rnd(F.col("q1")).alias("median"),
                   rnd(F.col("q2")).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    qs = qs.withColumn("_lo_fence", F.col("q1") - 1.5 * iqr).withColumn("_hi_fence", F.col("q3") + 1.5 * iqr)
    v = F.col(col)
    qs = broadcast_if_small(qs.withColumnRenamed(by, "_by"), 100_000, check=not approx)
    joined = df.where(v.isNotNull()).select(by, col).join(qs, F.col(by).eqNullSafe(F.col("_by")))
    inside = (v >= F.col("_lo_fence")) & (v <= F.col("_hi_fence"))
    return (joined.groupBy(by, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.min(F.when(inside, v)).alias("lower_whisker"), F.max(F.when(inside, v)).alias("upper_whisker"),
        F.count_if(~inside).alias("outliers"))
        .select(by, "n", "min", "q1", "median", "q3", "max", "lower_whisker", "upper_whisker", "outliers")
        .orderBy(by))


def top_n(df: DataFrame, col: str, n: int = TOP_N, ascending: bool = False,
          cols: Sequence[str] | None = None, tiebreak: str = "customer_id") -> DataFrame:
    """The ``n`` first rows by ``col`` (ties by ``tiebreak``);
    plans as a TakeOrderedAndProject (per-task top-n, then a merge)."""
    key = F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()
    out = df.orderBy(key, F.asc(tiebreak)).limit(n)
    return out.select(*cols) if cols else out


def points(df: DataFrame, x: str = "clv_proxy", y: str = "churn_probability", by: str = "segment",
           label: str = "customer_id") -> DataFrame:
    """The point set of a scatter plot, one point a customer."""
    return df.select(label, by, x, y)
