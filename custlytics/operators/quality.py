"""Data-quality checks on a transaction table.

Each check is a DataFrame; ``run_validation`` fuses the scalar checks into
one scan, the per-customer checks into one aggregation and the per-id check
into another, and returns them in long form."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlytics.functions.dates import day
from custlytics.schemas import TX, TxCols


def _flag_sum(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END): null on an empty table, like SQL."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def _role(tx: DataFrame, name: str) -> Column:
    """A role column, or null when the fact table lacks it (counted as null)."""
    return F.col(name) if name in tx.columns else F.lit(None)


def total_transactions(tx: DataFrame) -> DataFrame:
    """B1"""
    return tx.agg(F.count(F.lit(1)).alias("total_transactions"))


def total_customers(tx: DataFrame, cols: TxCols = TX, approx: bool = False) -> DataFrame:
    """B2 (exact by default; ``approx`` uses HyperLogLog++)."""
    c = F.approx_count_distinct(cols.customer) if approx else F.count_distinct(F.col(cols.customer))
    return tx.agg(c.alias("total_customers"))


def date_range(tx: DataFrame, cols: TxCols = TX) -> DataFrame:
    """B3"""
    return tx.agg(F.min(day(cols.date)).alias("min_transaction_date"),
                  F.max(day(cols.date)).alias("max_transaction_date"))


KEY_COLUMNS = ("id", "customer", "date", "value", "quantity")


def null_counts(tx: DataFrame, cols: TxCols = TX, roles: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """Null count per key column in one pass."""
    return tx.agg(*[_flag_sum(_role(tx, getattr(cols, r)).isNull()).alias(f"null_{getattr(cols, r)}")
                    for r in roles])


def duplicate_ids(tx: DataFrame, id_cols: str | Sequence[str] | None = None,
                  cols: TxCols = TX) -> DataFrame:
    """Ids occurring more than once, with their multiplicity (HAVING).

    Counting is partially aggregated before the shuffle, so a single id
    repeated on a third of all rows only ships one partial count per task."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols or [cols.id])
    return (tx.groupBy(*ids).agg(F.count(F.lit(1)).alias("duplicate_count"))
            .where(F.col("duplicate_count") > 1))


def duplicate_preview(tx: DataFrame, id_cols: str | Sequence[str] | None = None, n: int = 10,
                      cols: TxCols = TX) -> DataFrame:
    """The ``n`` most repeated ids (then by id) and, on each row, how
    many duplicated ids there are in all: what a validation report prints.  A
    top-N, so it plans as a TakeOrderedAndProject after the partial counts."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols or [cols.id])
    dups = duplicate_ids(tx, ids, cols)
    total = dups.agg(F.count(F.lit(1)).alias("duplicate_ids"))              # one row
    top = dups.orderBy(F.desc("duplicate_count"), *[F.asc(c) for c in ids]).limit(n)
    return top.crossJoin(F.broadcast(total))


def nonpositive_rows(tx: DataFrame, col: str, name: str) -> DataFrame:
    """Rows with ``col <= 0``."""
    return tx.agg(F.count_if(F.col(col) <= 0).alias(name))


def transactions_per_customer(tx: DataFrame, cols: TxCols = TX) -> DataFrame:
    return tx.groupBy(cols.customer).agg(F.count(cols.id).alias("_n"))


def one_time_customers(tx: DataFrame, cols: TxCols = TX) -> DataFrame:
    """Customers (SQL groups, the null key included) with one transaction."""
    return transactions_per_customer(tx, cols).agg(
        F.count_if(F.col("_n") == 1).alias("one_time_customers"))


def repeat_customers(tx: DataFrame, cols: TxCols = TX) -> DataFrame:
    """B9"""
    return transactions_per_customer(tx, cols).agg(
        F.count_if(F.col("_n") > 1).alias("repeat_customers"))


def distribution(tx: DataFrame, col: str, name: str = "transactions") -> DataFrame:
    """Rows per value, largest first (ties by value)."""
    return (tx.groupBy(col).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), F.asc_nulls_first(col)))


def distinct_distribution(tx: DataFrame, col: str, of: str = "customer_id",
                          name: str = "customers") -> DataFrame:
    """Distinct ``of`` per value, largest first."""
    return (tx.groupBy(col).agg(F.count_distinct(F.col(of)).alias(name))
            .orderBy(F.desc(name), F.asc_nulls_first(col)))


# ------------------------------------------------------------------- suite

def run_validation(tx: DataFrame, cols: TxCols = TX) -> DataFrame:
    """Every scalar check in long form
    ``(check_no, check_name, metric, value, status)``.

    Two aggregations in one plan: one customer-keyed aggregation carrying
    the row-level checks as partial sums (distinct, one-time, repeat, nulls,
    non-positive values, dates) and one id-keyed aggregation (duplicates).
    ``status`` is PASS/FAIL for checks that should be zero (NO DATA where
    the table is empty) and INFO otherwise."""
    # Every scalar check is additive, so it rides along as a per-customer
    # partial in the one customer-keyed aggregation and is re-aggregated over
    # the (SQL-style, null key included) customer groups: one scan of the
    # fact table for checks 1-4 and 6-9, one more keyed on the id for 5.
    per = tx.groupBy(cols.customer).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(cols.id).alias("_n"),
        F.min(day(cols.date)).alias("_min_d"), F.max(day(cols.date)).alias("_max_d"),
        *[F.count_if(_role(tx, getattr(cols, r)).isNull()).alias(f"_null_{r}") for r in KEY_COLUMNS],
        F.count_if(_role(tx, cols.value) <= 0).alias("_npv"),
        F.count_if(_role(tx, cols.quantity) <= 0).alias("_npq"))
    zero = F.lit(0).cast("bigint")
    scalar_and_customer = per.agg(
        F.coalesce(F.sum("_rows"), zero).alias("total_transactions"),
        F.min("_min_d").cast("string").alias("min_transaction_date"),
        F.max("_max_d").cast("string").alias("max_transaction_date"),
        *[F.sum(f"_null_{r}").cast("bigint").alias(f"null_{getattr(cols, r)}") for r in KEY_COLUMNS],
        F.coalesce(F.sum("_npv"), zero).alias("non_positive_order_value_rows"),
        F.coalesce(F.sum("_npq"), zero).alias("non_positive_quantity_rows"),
        F.count(cols.customer).alias("total_customers"),
        F.count_if(F.col("_n") == 1).alias("one_time_customers"),
        F.count_if(F.col("_n") > 1).alias("repeat_customers"))
    dups = duplicate_ids(tx, cols=cols).agg(F.count(F.lit(1)).alias("duplicate_ids"))
    one = scalar_and_customer.crossJoin(dups)   # two 1-row frames
    checks = [
        (1, "total_transactions", "total_transactions", "INFO"),
        (2, "total_customers", "total_customers", "INFO"),
        (3, "date_range", "min_transaction_date", "INFO"),
        (3, "date_range", "max_transaction_date", "INFO"),
        *[(4, "null_check", f"null_{getattr(cols, r)}", "ZERO") for r in KEY_COLUMNS],
        (5, "duplicate_transaction_id", "duplicate_ids", "ZERO"),
        (6, "non_positive_order_value", "non_positive_order_value_rows", "ZERO"),
        (7, "non_positive_quantity", "non_positive_quantity_rows", "ZERO"),
        (8, "one_time_customers", "one_time_customers", "INFO"),
        (9, "repeat_customers", "repeat_customers", "INFO"),
    ]
    rows = [F.struct(F.lit(no).alias("check_no"), F.lit(check).alias("check_name"),
                     F.lit(metric).alias("metric"), F.col(metric).cast("string").alias("value"),
                     (F.when(F.col(metric).isNull(), "NO DATA").when(F.col(metric).cast("bigint") == 0, "PASS")
                      .otherwise("FAIL") if rule == "ZERO" else F.lit("INFO")).alias("status"))
            for no, check, metric, rule in checks]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def validation_checks(tx: DataFrame, cols: TxCols = TX) -> dict[str, Callable[[], DataFrame]]:
    """B13 by name: the twelve checks, each a function that builds its whole
    result, so that one which cannot (a missing column) fails alone."""
    return {
        "total_transactions": lambda: total_transactions(tx),
        "total_customers": lambda: total_customers(tx, cols),
        "date_range": lambda: date_range(tx, cols),
        "null_counts": lambda: null_counts(tx, cols),
        "duplicate_ids": lambda: duplicate_ids(tx, cols=cols),
        "non_positive_order_value": lambda: nonpositive_rows(tx, cols.value, "non_positive_order_value_rows"),
        "non_positive_quantity": lambda: nonpositive_rows(tx, cols.quantity, "non_positive_quantity_rows"),
        "one_time_customers": lambda: one_time_customers(tx, cols),
        "repeat_customers": lambda: repeat_customers(tx, cols),
        "channel_distribution": lambda: distribution(tx, cols.channel),
        "category_distribution": lambda: distribution(tx, cols.category),
        "state_distribution": lambda: distinct_distribution(tx, cols.state, cols.customer),
    }


@dataclass
class CheckResult:
    """Outcome of one check: its rows (the first ``preview``) and how many
    there are in all, or the error that stopped it."""
    name: str
    columns: list[str]
    rows: list[tuple]
    total: int
    error: str | None = None


def run_checks(tx: DataFrame, cols: TxCols = TX, preview: int = 10) -> list[CheckResult]:
    """B13 as the report runs it: every check on its own, errors kept apart."""
    out = []
    for name, build in validation_checks(tx, cols).items():
        try:
            df = build()
            rows = [tuple(r) for r in df.limit(preview).collect()]
            out.append(CheckResult(name, df.columns, rows, len(rows) if len(rows) < preview else df.count()))
        except Exception as e:  # noqa: BLE001 -- the report goes on with the next check
            out.append(CheckResult(name, [], [], 0, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"))
    return out
