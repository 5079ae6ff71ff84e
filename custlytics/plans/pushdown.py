"""Aggregate-before-join plan shapes.

Spark does not push an aggregate below a join.  When a count only needs a
dimension attribute (a product's category, a customer's state) the builder
counts per dimension key on the fact side first, so the join sees one row
per distinct key instead of one per fact row, and the final aggregate runs
over the (small) attribute domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_through_dimension(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str,
                            attrs: Sequence[str], name: str = "count") -> DataFrame:
    """COUNT(*) of ``fact LEFT JOIN dim`` grouped by ``attrs`` of the dimension
    (``dim_key`` must be unique in ``dim``)."""
    per_key = fact.groupBy(F.col(fact_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    d = dim.select(F.col(dim_key).alias("_k"), *attrs)
    return per_key.join(d, "_k", "left").groupBy(*attrs).agg(F.sum("_n").cast("bigint").alias(name))


def distinct_through_dimension(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str,
                               attrs: Sequence[str], name: str = "count") -> DataFrame:
    """COUNT(DISTINCT fact_key) of ``fact LEFT JOIN dim`` grouped by ``attrs``
    (valid when the attributes are a function of the key)."""
    keys = fact.where(F.col(fact_key).isNotNull()).select(F.col(fact_key).alias("_k")).distinct()
    d = dim.select(F.col(dim_key).alias("_k"), *attrs)
    return keys.join(d, "_k", "left").groupBy(*attrs).agg(F.count(F.lit(1)).alias(name))
