"""Command line: run the analyses over a transaction table.

  python -m custlytics validate --tx PATH [--fmt csv|parquet]
  python -m custlytics reports  --tx PATH --out DIR [--fmt csv|parquet]
                                [--out-fmt parquet|csv] [--model]

``validate`` prints the checks and exits with 1 if one fails.  ``reports``
writes rfm, segments, segment_summary, cohort_retention, customer_churn and
model_base under DIR, one folder per result; with ``--model`` also the search
results, report, confusion matrix, ROC-AUC, churn_predictions and attribution
tables of the churn model, and the model itself.

The session is the one spark-submit configures (its master included); run
directly, Spark's own default applies."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    return SparkSession.builder.appName("custlytics").getOrCreate()


def _load(spark, path: str, fmt: str):
    """The transactions; a CSV is parsed once and landed as a month-partitioned table."""
    from custlytics.session import scratch_path, track
    from custlytics.sources.transactions import load_transactions, read_transactions, write_transactions
    tx = read_transactions(spark, path, fmt=fmt)
    if fmt == "parquet":
        return tx
    target = scratch_path(spark, "transactions")
    track(spark, target)
    write_transactions(tx, target)
    return load_transactions(spark, target, tx.schema.add("order_month", "string"))


def _show(value) -> str:
    return "-" if value is None else str(value)


def run_validate(spark, args) -> int:
    from custlytics.session import release_scratch, scratch_mark
    mark = scratch_mark(spark)
    try:
        return _validate(_load(spark, args.tx, args.fmt), args.preview)
    finally:
        release_scratch(spark, mark)


def _validate(tx, preview: int) -> int:
    from custlytics.operators.quality import run_checks, run_validation
    failed = False
    for c in run_checks(tx, preview=preview):
        if c.error:
            failed = True
            print(f"[{c.name}] ERROR {c.error}")
            continue
        print(f"[{c.name}] {', '.join(c.columns)}")
        for r in c.rows:
            print("   " + " | ".join(_show(v) for v in r))
        if c.total > len(c.rows):
            print(f"   ... {c.total - len(c.rows)} more of {c.total} rows")
    try:
        summary = run_validation(tx).orderBy("check_no", "metric").collect()
    except Exception as e:  # noqa: BLE001 -- the checks above stand without the summary
        print(f"[summary] ERROR {type(e).__name__}: {str(e).splitlines()[0][:200]}")
        return 1
    for r in summary:
        failed |= r.status == "FAIL"
        print(f"{r.check_no:>2} {r.check_name:<26} {r.metric:<32} {_show(r.value):>14} {r.status}")
    return 1 if failed else 0


def _model_results(spark, base, out: str, args) -> dict:
    from custlytics.operators import ml
    from custlytics.operators.attribution import attribution_importance, attribution_summary, tree_attributions
    from custlytics.session import materialize
    frame = materialize(ml.stratified_split(ml.assemble_features(base, keep=["segment"])))
    grid = ml.PARAM_GRID if not args.quick else {
        "n_estimators": [10], "max_depth": [3], "learning_rate": [0.1], "subsample": [1.0], "colsample_bytree": [1.0]}
    best, tried = ml.random_search(frame.where("split = 'train'"), grid, n_iter=args.search_iterations)
    print("model ->", ml.save_model(best, f"{out}/model"))
    rows = [(i, ", ".join(f"{k}={v}" for k, v in sorted(p.items())), float(auc)) for i, (p, auc) in enumerate(tried)]
    scored = materialize(ml.score(best, frame.where("split = 'test'")))
    attr = materialize(tree_attributions(best, frame))
    return {
        "model_search": spark.createDataFrame(rows, "candidate int, params string, cv_auc double"),
        "classification_report": ml.classification_report(scored),
        "confusion_matrix": ml.confusion_matrix(scored),
        "roc_auc": ml.roc_auc(scored),
        "churn_predictions": ml.churn_predictions(best, base),
        "attribution_importance": attribution_importance(attr),
        "attribution_summary": attribution_summary(attr),
    }


def run_reports(spark, args) -> int:
    from custlytics.session import release_scratch, scratch_mark
    mark = scratch_mark(spark)
    try:
        return _reports(spark, args)
    finally:
        release_scratch(spark, mark)


def _reports(spark, args) -> int:
    from pyspark.sql import functions as F

    from custlytics.operators import cohort, customer, rfm
    from custlytics.session import materialize
    from custlytics.sources.transactions import write_result
    tx = _load(spark, args.tx, args.fmt)
    out = args.out.rstrip("/")
    # one customer aggregate feeds RFM, segments, churn and the model base
    base = materialize(customer.customer_model_base(tx))
    segments = base.select("customer_id", "recency", "frequency", "monetary", "r_score", "f_score", "m_score", "rfm_score", "segment")
    results = {
        "rfm": base.select("customer_id", "recency", "frequency", "monetary").orderBy(F.desc("monetary"), "customer_id"),
        "segments": segments,
        "segment_summary": rfm.segment_summary(segments),
        "cohort_retention": cohort.cohort_retention(tx),
        "customer_churn": base.drop(*customer.SCORE_COLUMNS).orderBy("customer_id"),
        "model_base": base,
    }
    if args.model:
        results.update(_model_results(spark, base, out, args))
    for name, df in results.items():
        print(name, "->", write_result(df, f"{out}/{name}", fmt=args.out_fmt))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m custlytics")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("validate", "reports"):
        s = sub.add_parser(name)
        s.add_argument("--tx", required=True, help="transaction table (CSV with header, or Parquet)")
        s.add_argument("--fmt", default="csv", choices=["csv", "parquet"])
        if name == "validate":
            s.add_argument("--preview", type=int, default=10, help="rows printed of a longer result")
        if name == "reports":
            s.add_argument("--out", required=True)
            s.add_argument("--out-fmt", default="parquet", choices=["parquet", "csv"])
            s.add_argument("--model", action="store_true", help="also fit the churn model")
            s.add_argument("--search-iterations", type=int, default=10)
            s.add_argument("--quick", action="store_true", help="one small model instead of the grid")
    args = p.parse_args(argv)
    spark = _session()
    return run_validate(spark, args) if args.cmd == "validate" else run_reports(spark, args)


if __name__ == "__main__":
    sys.exit(main())
