"""Model-fitting queries (rows-only in the driver) run end to end; save and
reload give the same scores; attributions add up to the margin."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF001

import __spark_entry__ as E
from custlytics import catalog as CAT
from custlytics.operators import attribution as A
from custlytics.operators import ml as M
from custlytics.session import scratch_path

ROWS_ONLY = sorted(set(E.queries()) - set(E.oracle_sql()))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF001)
    assert df.count() > 0


def test_save_load_roundtrip(spark):
    frame, model = CAT._fitted(spark, SF001)
    path = M.save_model(model, scratch_path(spark, "model-test"))
    again = M.load_model(path)
    a = M.score(model, frame).select("customer_id", F.col("churn_probability").alias("a"))
    b = M.score(again, frame).select("customer_id", F.col("churn_probability").alias("b"))
    assert a.join(b, "customer_id").where(F.col("a") != F.col("b")).count() == 0


def test_attributions_add_up_to_margin(spark):
    frame, model = CAT._fitted(spark, SF001)
    attr = A.tree_attributions(model, frame)
    per = attr.groupBy("customer_id").agg((F.sum("attribution") + F.first("expected_value")).alias("recon"))
    margin = model.transform(frame).select("customer_id", vector_to_array("rawPrediction")[1].alias("m"))
    err = per.join(margin, "customer_id").agg(F.max(F.abs(F.col("recon") - F.col("m")))).first()[0]
    assert err < 1e-9


def test_probability_is_logistic_of_twice_the_margin(spark):
    frame, model = CAT._fitted(spark, SF001)
    out = model.transform(frame).select(vector_to_array("rawPrediction")[1].alias("m"),
                                        vector_to_array("probability")[1].alias("p"))
    err = out.agg(F.max(F.abs(F.col("p") - 1 / (1 + F.exp(-2 * F.col("m")))))).first()[0]
    assert err < 1e-12


def test_param_grid_sampling_is_deterministic():
    a = M.sample_param_grid(n_iter=10, seed=42)
    assert a == M.sample_param_grid(n_iter=10, seed=42)
    assert len({tuple(sorted(d.items())) for d in a}) == 10
