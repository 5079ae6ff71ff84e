"""Recency / frequency / monetary features, quartile scores and segments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlytics.functions.dates import day
from custlytics.functions.money import cents, exact_mean, from_cents, total_units, units_to_cents
from custlytics.operators.rank import check_unique_edges, rank_quantile_edges, score_by_edges
from custlytics.operators.select import after, find
from custlytics.schemas import TX, TxCols
from custlytics.session import materialize

# ---- fixed values (must equal the reference for identical results) --------
# Segment rules, checked in this order; scores are 1..4.  A rule matches when
# every listed score lies in its inclusive range.
SEGMENT_RULES = (
    ("High-Value", {"r": (3, 4), "f": (3, 4), "m": (3, 4)}),
    ("Repeat", {"r": (3, 4), "f": (2, 4)}),
    ("At-Risk", {"r": (1, 2), "f": (1, 2), "m": (1, 2)}),
)
DEFAULT_SEGMENT = "Low-Engagement"
QUARTILES = (0.25, 0.5, 0.75)
RECENCY_LABELS = (4, 3, 2, 1)   # lower recency is better
RANK_LABELS = (1, 2, 3, 4)      # higher frequency / spend is better
# Tie order for the frequency rank: equal counts rank the bigger spender
# first (the reference ranks in its input order, which is spend descending).
FREQUENCY_ORDER = (("frequency", True), ("monetary", False), ("customer_id", True))
MONETARY_ORDER = (("monetary", True), ("customer_id", True))
# ---------------------------------------------------------------------------


def dataset_end(tx: DataFrame, cols: TxCols = TX):
    """Latest transaction date (E1), computed once by a one-row aggregate
    that reads a single column.  Returned as a Python date so plans carry it
    as a literal: it is not re-evaluated per use, and range filters on it
    can prune Parquet row groups and month partitions."""
    return tx.select(F.max(day(cols.date))).first()[0]


def dataset_span(tx: DataFrame, cols: TxCols = TX):
    """Earliest and latest transaction date, by one one-row aggregate."""
    return tuple(tx.select(F.min(day(cols.date)), F.max(day(cols.date))).first())


def as_of_column(tx: DataFrame, as_of=None, cols: TxCols = TX) -> Column:
    value = as_of if as_of is not None else dataset_end(tx, cols)
    return F.lit(value).cast("date")


def on_or_after(df: DataFrame, col: str, start: Column, month_col: str = "order_month") -> Column:
    """``to_date(col) >= start`` written so it pushes down to the scan when
    ``col`` is a timestamp (compare the raw value with midnight).  On a table
    partitioned by ``order_month`` (as ``write_transactions`` writes it) the
    implied ``order_month >= 'yyyy-MM'`` is added, so whole month folders
    are pruned; it never changes the result."""
    dtype = dict(df.dtypes).get(col)
    if dtype == "timestamp_ntz":
        cond = F.col(col) >= F.to_timestamp_ntz(F.date_format(start, "yyyy-MM-dd"))
    elif dtype == "timestamp":
        cond = F.col(col) >= start.cast("timestamp")
    else:
        cond = day(col) >= start
    if month_col in df.columns and dict(df.dtypes).get(month_col) == "string":
        cond = cond & (F.col(month_col) >= F.date_format(start, "yyyy-MM"))
    return cond


def customers_only(tx: DataFrame, cols: TxCols = TX) -> DataFrame:
    """Rows with a null customer are reported by the quality checks and kept
    out of per-customer features."""
    return tx.where(F.col(cols.customer).isNotNull())


def money_sum(c: str) -> Column:
    """The sum rounded once, half-up to cents, as double."""
    return from_cents(units_to_cents(total_units(c)))


def rfm(tx: DataFrame, as_of=None, cols: TxCols = TX, sort: bool = True) -> DataFrame:
    """One row per customer with recency (days from ``as_of``, default the
    dataset end), frequency and monetary; ordered by monetary descending.

    One shuffle on the customer key after map-side partial aggregation, so a
    customer holding a third of all rows costs no more than any other."""
    end = as_of_column(tx, as_of, cols)
    out = customers_only(tx, cols).groupBy(F.col(cols.customer).alias("customer_id")).agg(
        F.datediff(end, F.max(day(cols.date))).alias("recency"),
        F.count(cols.id).alias("frequency"),
        money_sum(cols.value).alias("monetary"),
    )
    return out.orderBy(F.desc("monetary"), F.asc("customer_id")) if sort else out


# ---------------------------------------------------------------- scoring

def value_quartile_edges(df: DataFrame, col: str, with_count: bool = False):
    """min, exact quartiles (linear interpolation) and max of ``col`` (and the
    row count, in the same one-row aggregate, when ``with_count``).

    ``percentile`` keeps one counter per distinct value, which is what a
    day-count column needs (a few thousand distinct values at most); it is
    not meant for continuous measures (use ``exact_quantiles``)."""
    row = df.agg(F.min(col).alias("lo"),
                 F.percentile(F.col(col), F.array(*[F.lit(p) for p in QUARTILES])).alias("q"),
                 F.max(col).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    edges = [] if row is None or row["lo"] is None else \
        [float(row["lo"]), *[float(x) for x in row["q"]], float(row["hi"])]
    return (edges, int(row["n"])) if with_count else edges


def quartile_score(col: str, edges: Sequence[float], labels: Sequence[int],
                   duplicates: str = "raise") -> Column:
    """Right-closed quartile bins over ``[min, q1, q2, q3, max]``."""
    uniq = check_unique_edges(edges, duplicates)
    labels = list(labels)
    if len(uniq) != len(edges):  # only with duplicates="drop": fewer bins
        k = max(1, len(uniq) - 1)
        labels = list(range(k, 0, -1)) if labels[0] > labels[-1] else list(range(1, k + 1))
    return score_by_edges(F.col(col), uniq[1:-1], labels)


def rank_quartile_score(rank_col: str, n: int, labels: Sequence[int] = RANK_LABELS) -> Column:
    """Quartile bins of a 1..n rank (edges 1+(n-1)p; not ``ntile``)."""
    edges = [1.0, *rank_quantile_edges(n, QUARTILES), float(n)]
    check_unique_edges(edges, "raise")
    return score_by_edges(F.col(rank_col), edges[1:-1], labels)


def assign_segment(r: Column | str = "r_score", f: Column | str = "f_score",
                   m: Column | str = "m_score", rules=SEGMENT_RULES,
                   default: str = DEFAULT_SEGMENT) -> Column:
    """First matching rule wins (an ordered CASE, no Python UDF)."""
    score = {"r": F.col(r) if isinstance(r, str) else r,
             "f": F.col(f) if isinstance(f, str) else f,
             "m": F.col(m) if isinstance(m, str) else m}
    expr = None
    for label, conds in rules:
        cond = F.lit(True)
        for k, (lo, hi) in conds.items():
            cond = cond & score[k].between(lo, hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def rfm_score(r="r_score", f="f_score", m="m_score") -> Column:
    """Concatenated score text such as ``"434"``."""
    return F.concat(*[F.col(c).cast("string") for c in (r, f, m)])


def quartile_cuts(df: DataFrame, orders, n: int, labels: Sequence[int] = RANK_LABELS) -> list[Column]:
    """C3/C4 without ranking: for each order the quartile bin of a row's place.

    A rank lies past the edge ``1 + (n-1)p`` exactly when its row comes after
    the row at position ``floor((n-1)p)``, so three boundary rows an order are
    located, all in the same jobs, and every row is compared with them in a
    projection."""
    check_unique_edges([1.0, *rank_quantile_edges(n, QUARTILES), float(n)], "raise")
    places = [math.floor((n - 1) * p) for p in QUARTILES]
    named = {str(i): order for i, order in enumerate(orders)}
    found = find(df, named, {o: {(): sorted(set(places))} for o in named}, {(): n})
    above = [sum((after(df, order, found[o, (), at][0]).cast("int") for at in places), F.lit(0)) for o, order in named.items()]
    return [F.element_at(F.array(*[F.lit(int(x)) for x in labels]), a + 1) for a in above]


def quartile_cut(df: DataFrame, order, n: int, labels: Sequence[int] = RANK_LABELS) -> Column:
    """C3/C4 of one order."""
    return quartile_cuts(df, [order], n, labels)[0]


def score_customers(features: DataFrame, duplicates: str = "raise", materialized: bool = False) -> DataFrame:
    """C2-C7 on a per-customer table with recency, frequency, monetary.

    The table is written once (the quartile aggregate and the boundary search
    read its key columns); scores are a projection of it: no sort, no join.
    ``duplicates`` tells what to do with repeated recency edges."""
    base = features if materialized else materialize(features)
    edges, n = value_quartile_edges(base, "recency", with_count=True)
    if n == 0:
        empty = {c: F.lit(None).cast("int") for c in ("r_score", "f_score", "m_score")}
        return base.withColumns({**empty, "rfm_score": F.lit(None).cast("string"), "segment": F.lit(None).cast("string")})
    r = quartile_score("recency", edges, RECENCY_LABELS, duplicates) if edges else F.lit(None).cast("int")
    f, m = quartile_cuts(base, [FREQUENCY_ORDER, MONETARY_ORDER], n)
    out = base.withColumns({"r_score": r, "f_score": f, "m_score": m})
    return out.withColumns({"rfm_score": rfm_score(), "segment": assign_segment()})


def rfm_segments(tx: DataFrame, as_of=None, cols: TxCols = TX, **kw) -> DataFrame:
    return score_customers(rfm(tx, as_of, cols, sort=False), **kw)


def segment_summary(segments: DataFrame, decimals: int | None = None) -> DataFrame:
    """Size and mean recency/frequency/monetary per segment.

    With ``decimals`` the means are computed from exact integer sums and
    rounded half-up (stable across engines and partitionings)."""
    if decimals is None:
        means = [F.avg("recency").alias("avg_recency"), F.avg("frequency").alias("avg_frequency"),
                 F.avg("monetary").alias("avg_monetary")]
    else:
        n = F.count("customer_id")
        means = [exact_mean(F.sum("recency"), n, 0, decimals).alias("avg_recency"),
                 exact_mean(F.sum("frequency"), n, 0, decimals).alias("avg_frequency"),
                 exact_mean(F.sum(cents("monetary")), n, 2, decimals).alias("avg_monetary")]
    return (segments.groupBy("segment").agg(F.count("customer_id").alias("customers"), *means)
            .orderBy(F.desc("customers"), F.asc("segment")))


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Counts per non-null value, largest first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), F.asc(col)))
