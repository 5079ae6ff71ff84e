"""Golden: segmenting a published per-customer RFM table (customer_id,
recency, frequency, monetary; 1,200 rows) reproduces the published segment
summary below.  The CSV is read in place from the path in
``CUSTLYTICS_GOLDEN_RFM_CSV``; the test is skipped when it is not set."""

import os

import pytest

from custlytics.operators import rfm as R

FEATURES = os.environ.get("CUSTLYTICS_GOLDEN_RFM_CSV", "")
EXPECTED = {  # segment: customers, avg_recency, avg_frequency, avg_monetary
    "High-Value": (391, 7.820972, 18.033248, 75292.800102),
    "At-Risk": (385, 68.883117, 6.748052, 11966.134753),
    "Low-Engagement": (275, 33.330909, 12.396364, 40864.124727),
    "Repeat": (149, 9.053691, 9.677852, 19420.318121),
}


@pytest.mark.skipif(not (FEATURES and os.path.exists(FEATURES)), reason="golden RFM table not given")
def test_published_segments(spark):
    df = spark.read.schema("customer_id string, recency int, frequency bigint, monetary double") \
        .option("header", True).csv(FEATURES)
    seg = R.score_customers(df)
    got = {r.segment: r for r in R.segment_summary(seg, decimals=6).collect()}
    for name, (n, rec, freq, mon) in EXPECTED.items():
        r = got[name]
        assert (r.customers, r.avg_recency, r.avg_frequency, r.avg_monetary) == (n, rec, freq, mon)
