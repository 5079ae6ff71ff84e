"""Shared access to the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table, in order.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder through Spark's own reader (the folder may
    live in a store that only Spark can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settled(df: DataFrame, keep: list[str], name: str, value: Column) -> DataFrame:
    """``keep`` columns and ``name`` = ``value``, computed here: a later filter
    on it stays above.  (Moved below, the filter would take along copies of
    the expressions ``value`` is made of, into lambdas once for each element.)"""
    return df.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.array(value)).alias(name))


def parallelism(spark: SparkSession) -> int:
    """Reduce-side partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
