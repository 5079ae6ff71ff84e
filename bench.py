"""Headline-query benchmark.

Runs the main queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line with per-query wall
seconds.  Each query is executed in full into Spark's ``noop`` sink (no
collect to the driver)."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "rfm", "rfm_segments", "segment_summary", "dq_suite", "dist_category", "dist_state",
    "cohort_retention", "cohort_matrix", "cohort_assign", "customer_churn", "model_base", "kpi_row",
    "segment_performance", "box_clv", "top_risk", "stratified_split", "roc_auc",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from custlytics.catalog import QUERIES
    from custlytics.session import local_session, release_scratch
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    # untimed warm-up (JVM JIT, class loading, file footers): one full
    # customer-level query
    QUERIES["customer_churn"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        release_scratch(spark)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
