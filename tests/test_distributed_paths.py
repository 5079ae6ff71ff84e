"""Rank-based queries equal the oracle at any partitioning, and no plan has a
window over all rows in one task."""

import os

import duckdb
import pytest

from conftest import SF01

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest

RANKED = ["global_rank", "score_frequency", "rfm_segments", "segment_summary", "model_base",
          "box_churn_probability", "box_clv", "stratified_split", "class_weight", "roc_auc",
          "classification_report", "kpi_row"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF01}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", RANKED)
def test_many_partitions_match_oracle(spark, con, name):
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        _equals_oracle(spark, con, name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def _equals_oracle(spark, con, name):
    df = E.queries()[name](spark, SF01)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


WINDOWED = ["global_rank", "rfm_segments", "cohort_retention", "cohort_latest", "model_base",
            "box_clv", "stratified_split", "roc_auc", "classification_report", "kpi_row"]


def _windows_over_single_partition(plan: str) -> list[str]:
    """Window operators whose nearest exchange below is a single partition."""
    final = plan.split("== Initial Plan ==")[0].splitlines()
    bad = []
    for i, ln in enumerate(final):
        if "Window [" not in ln:
            continue
        for below in final[i + 1:]:
            if "Exchange" in below:
                if "SinglePartition" in below:
                    bad.append(ln.strip()[:120])
                break
    return bad


@pytest.mark.parametrize("name", WINDOWED)
def test_no_unpartitioned_window(spark, name):
    df = E.queries()[name](spark, SF01)
    df.write.format("noop").mode("overwrite").save()
    assert _windows_over_single_partition(df._jdf.queryExecution().executedPlan().toString()) == []


def test_detector_sees_an_unpartitioned_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(10).withColumn("r", F.row_number().over(Window.orderBy("id")))
    df.collect()
    assert _windows_over_single_partition(df._jdf.queryExecution().executedPlan().toString())
