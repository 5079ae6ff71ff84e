"""custlytics: customer analytics (quality checks, RFM segments, cohort
retention, churn and lifetime value, churn model and attributions, and the
analyst views over them) as Spark DataFrame operators.

The main entry points are re-exported here; every name is lazy so importing
the package does not start or require a Spark session."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_EXPORTS = {
    # sources / sinks
    "read_transactions": "custlytics.sources.transactions",
    "write_transactions": "custlytics.sources.transactions",
    "load_transactions": "custlytics.sources.transactions",
    "write_result": "custlytics.sources.transactions",
    "read_result": "custlytics.sources.transactions",
    "run_reports": "custlytics.sources.transactions",
    "ingest_stream": "custlytics.streaming.ingest",
    # quality
    "run_validation": "custlytics.operators.quality",
    # RFM and segments
    "rfm": "custlytics.operators.rfm",
    "score_customers": "custlytics.operators.rfm",
    "segment_summary": "custlytics.operators.rfm",
    # cohorts
    "cohort_retention": "custlytics.operators.cohort",
    "cohort_assign": "custlytics.operators.cohort",
    "cohort_matrix": "custlytics.operators.cohort",
    # churn and CLV
    "customer_churn": "custlytics.operators.customer",
    "customer_model_base": "custlytics.operators.customer",
    # model
    "stratified_split": "custlytics.operators.ml",
    "random_search": "custlytics.operators.ml",
    "fit_churn_model": "custlytics.operators.ml",
    "churn_predictions": "custlytics.operators.ml",
    "classification_report": "custlytics.operators.ml",
    "roc_auc": "custlytics.operators.ml",
    "tree_attributions": "custlytics.operators.attribution",
    # views
    "churn_scores": "custlytics.operators.views",
    "filter_customers": "custlytics.operators.views",
    "kpis": "custlytics.operators.views",
    # primitives
    "global_rank": "custlytics.operators.rank",
    "exact_quantiles": "custlytics.operators.rank",
    "TxCols": "custlytics.schemas",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name in _EXPORTS:
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(f"module 'custlytics' has no attribute {name!r}")
