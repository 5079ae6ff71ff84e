"""Sources and sinks: CSV/Parquet round-trips, partitioned table, reports,
streaming ingest."""

import os

from pyspark.sql import functions as F

from conftest import SF001

from custlytics.sources import testdata as TD
from custlytics.sources import transactions as S
from custlytics.streaming.ingest import ingest_stream


def _csv_tx(spark, sf=SF001):
    tx = TD.transactions(spark, sf)
    return tx.select(F.col("transaction_id").cast("string"), F.col("customer_id").cast("string"),
                     F.date_format("transaction_date", "yyyy-MM-dd").alias("transaction_date"),
                     "order_value", "quantity", F.lit("cat").alias("product_category"),
                     "payment_method", "channel", "discount_used_pct",
                     F.lit("seg").alias("customer_profile_segment"), F.lit("city").alias("customer_city"),
                     F.lit("state").alias("customer_state"), F.lit(None).cast("string").alias("signup_date"))


def test_csv_roundtrip_and_partitioned_table(spark, tmp_out):
    src = f"{tmp_out}/raw"
    S.write_result(_csv_tx(spark).coalesce(2), src, fmt="csv")
    tx = S.read_transactions(spark, src)
    assert dict(tx.dtypes)["transaction_date"] == "timestamp_ntz"
    n = S.write_transactions(tx, f"{tmp_out}/table")
    assert n == 1500
    assert any(p.startswith("order_month=") for p in os.listdir(f"{tmp_out}/table"))
    back = S.load_transactions(spark, f"{tmp_out}/table")
    assert back.count() == 1500
    prof = S.profile(tx)
    assert prof.shape == (1500, 13) and prof.preview.count() == 5


def test_reports_batch(spark, tmp_out):
    tx = TD.transactions(spark, SF001)
    out = S.run_reports(spark, tx, tmp_out)
    assert set(out) == {"rfm_output", "cohort_output", "churn_output"}
    assert S.read_result(spark, out["rfm_output"]).count() == 150


def test_export_view_csv(spark, tmp_out):
    df = spark.createDataFrame([("a", 0.5)], "customer_id string, churn_probability double")
    p = S.export_view(df, f"{tmp_out}/view")
    back = S.read_result(spark, p, "customer_id string, churn_probability double", fmt="csv")
    assert [tuple(r) for r in back.collect()] == [("a", 0.5)]


def test_streaming_ingest_is_exactly_once(spark, tmp_out):
    src, target, ck = f"{tmp_out}/drop", f"{tmp_out}/t", f"{tmp_out}/ck"
    S.write_result(_csv_tx(spark).coalesce(3), src, fmt="csv")
    q = ingest_stream(spark, src, target, ck)
    q.awaitTermination(120)
    assert spark.read.parquet(target).count() == 1500
    q = ingest_stream(spark, src, target, ck)   # restart: nothing new
    q.awaitTermination(120)
    assert spark.read.parquet(target).count() == 1500


def test_command_line_reports(spark, tmp_out, capsys):
    from custlytics.__main__ import main
    src = f"{tmp_out}/raw"
    S.write_result(_csv_tx(spark).coalesce(2), src, fmt="csv")
    # 27 orders have no lines at sf0.001: null quantities fail the check
    assert main(["validate", "--tx", src]) == 1
    lines = capsys.readouterr().out.splitlines()
    assert any("null_quantity" in ln and "27" in ln and ln.endswith("FAIL") for ln in lines)
    assert main(["reports", "--tx", src, "--out", f"{tmp_out}/out"]) == 0
    for name, n in [("rfm", 150), ("segments", 150), ("segment_summary", 4), ("customer_churn", 150),
                    ("model_base", 150)]:
        assert S.read_result(spark, f"{tmp_out}/out/{name}").count() == n
    assert S.read_result(spark, f"{tmp_out}/out/cohort_retention").count() > 0


def test_command_line_model_reports(spark, tmp_out):
    from custlytics.__main__ import main
    src = f"{tmp_out}/raw"
    S.write_result(_csv_tx(spark).coalesce(2), src, fmt="csv")
    assert main(["reports", "--tx", src, "--out", f"{tmp_out}/out", "--model", "--quick",
                 "--search-iterations", "1"]) == 0
    assert S.read_result(spark, f"{tmp_out}/out/churn_predictions").count() == 150
    assert S.read_result(spark, f"{tmp_out}/out/attribution_importance").count() == 12
    for name, n in [("model_search", 1), ("classification_report", 5), ("confusion_matrix", 4), ("roc_auc", 1), ("attribution_summary", 12)]:
        assert S.read_result(spark, f"{tmp_out}/out/{name}").count() == n
    from custlytics.operators.ml import load_model
    assert len(load_model(f"{tmp_out}/out/model").trees.feature) == 10


def test_command_line_on_an_empty_table(spark, tmp_out, capsys):
    from custlytics.__main__ import main
    src = f"{tmp_out}/raw"
    S.write_result(_csv_tx(spark).limit(0).coalesce(1), src, fmt="csv")
    assert main(["validate", "--tx", src]) == 0
    assert "NO DATA" in capsys.readouterr().out


def test_command_line_keeps_the_submitted_master(tmp_path):
    """A fresh process, as spark-submit starts one, keeps its master."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import custlytics.__main__ as m; print('MASTER', m._session().sparkContext.master)"
    env = {**os.environ, "PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120, cwd=tmp_path)
    assert "MASTER local[2]" in out.stdout, out.stderr[-500:]


def test_bad_rows_modes(spark, tmp_out):
    import pytest
    path = f"{tmp_out}/bad.csv"
    header = ",".join(f.name for f in S.TRANSACTIONS.fields)
    tail = "cat,card,web,0.1,seg,city,state,2024-01-01"
    with open(path, "w") as f:
        f.write(header + "\n")
        f.write(f"t1,A,2025-01-01,10.5,1,{tail}\n")
        f.write(f"t2,B,2025-01-02,not-a-number,2,{tail}\n")
        f.write(f"t3,C,garbage,3.0,3,{tail}\n")
    keep = S.read_transactions(spark, path, keep_corrupt=True)
    rows = {r.transaction_id: r for r in keep.collect()}
    assert rows["t1"]._corrupt_record is None and rows["t1"].order_value == 10.5
    assert rows["t2"].order_value is None and rows["t2"]._corrupt_record is not None
    assert rows["t3"].transaction_date is None and rows["t3"]._corrupt_record is None   # bad date -> null
    assert {r.transaction_id for r in S.read_transactions(spark, path, bad_rows="drop").collect()} == {"t1", "t3"}
    with pytest.raises(Exception):
        S.read_transactions(spark, path, bad_rows="fail").collect()


def test_release_scratch_removes_only_our_tables(spark):
    import os
    from custlytics.session import _WRITTEN, materialize, release_scratch, scratch_mark
    mark = scratch_mark(spark)                  # other tests' tables stay
    df = materialize(spark.range(10))
    path = _WRITTEN[spark.sparkContext.applicationId][mark].replace("file:", "")
    assert os.path.isdir(path) and df.count() == 10
    assert release_scratch(spark, mark) == 1
    assert not os.path.exists(path)
    assert release_scratch(spark, mark) == 0 and scratch_mark(spark) == mark


def test_trailing_window_prunes_month_partitions(spark, tmp_out):
    from custlytics.operators import customer as E
    tx = TD.transactions(spark, SF001)
    S.write_transactions(tx, f"{tmp_out}/table")
    stored = S.load_transactions(spark, f"{tmp_out}/table")
    got = E.recent_activity(stored)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month" in text and "order_month#" in text.split("PartitionFilters:")[1][:200]
    expect = {tuple(r) for r in E.recent_activity(tx).collect()}
    assert {tuple(r) for r in got.collect()} == expect


def test_command_line_goes_on_without_the_summary(spark, tmp_out, capsys):
    from custlytics.__main__ import _validate
    tx = spark.createDataFrame([("t1", "c1", 1.0)], "transaction_id string, customer_id string, order_value double")
    assert _validate(tx, 5) == 1
    text = capsys.readouterr().out
    assert "[total_transactions]" in text and "[date_range] ERROR" in text and "[summary] ERROR" in text
