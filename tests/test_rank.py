"""Bucketed global rank / running sums / exact quantiles equal the
single-task answers, also when one key holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from custlytics.operators.rank import exact_quantiles, global_rank, global_running_sum, sorted_positions


def _frame(spark, n=3000, hot_share=1 / 3, seed=3):
    rng = np.random.default_rng(seed)
    freq = rng.integers(1, 40, n)
    freq[: int(n * hot_share)] = 7            # a hot leading key
    money = np.round(rng.random(n) * 1000, 2)
    money[:50] = 5.0                          # ties on the second key too
    pdf = pd.DataFrame({"customer_id": np.arange(n, dtype=np.int64), "frequency": freq.astype(np.int64),
                        "monetary": money})
    return spark.createDataFrame(pdf), pdf


def test_rank_many_buckets_equals_sort(spark):
    df, pdf = _frame(spark)
    order = [("frequency", True), ("monetary", False), ("customer_id", True)]
    got = global_rank(df, order, "r", partitions=30).toPandas().sort_values("customer_id")
    exp = pdf.sort_values(["frequency", "monetary", "customer_id"], ascending=[True, False, True])
    exp = exp.assign(r=np.arange(1, len(pdf) + 1)).sort_values("customer_id")
    assert (got["r"].to_numpy() == exp["r"].to_numpy()).all()


def test_hot_key_is_split_over_buckets(spark):
    df, _ = _frame(spark)
    s = sorted_positions(df, [("frequency", True), ("monetary", False), ("customer_id", True)], 30)
    per = s.groupBy("__pid").count().toPandas()
    assert per["count"].max() < 0.1 * 3000       # the 1000-row hot key is spread
    assert s.where("frequency = 7").select("__pid").distinct().count() > 5


def test_ranks_are_a_permutation(spark):
    df, _ = _frame(spark, n=777)
    r = global_rank(df, ["monetary", "customer_id"], partitions=20).select("rank").toPandas()
    assert sorted(r["rank"]) == list(range(1, 778))


def test_running_sum(spark):
    df, pdf = _frame(spark, n=1000)
    got = global_running_sum(df, ["monetary", "customer_id"], {"cum": F.col("frequency")},
                             partitions=16).toPandas().sort_values(["monetary", "customer_id"])
    exp = pdf.sort_values(["monetary", "customer_id"])["frequency"].cumsum().to_numpy()
    assert (got["cum"].to_numpy() == exp).all()


def test_exact_quantiles_match_numpy(spark):
    df, pdf = _frame(spark, n=901)
    pdf["g"] = pdf["customer_id"] % 3
    sdf = spark.createDataFrame(pdf)
    got = exact_quantiles(sdf, "monetary", (0.25, 0.5, 0.75), by=["g"]).toPandas().sort_values("g")
    for _, row in got.iterrows():
        vals = pdf.loc[pdf["g"] == row["g"], "monetary"].to_numpy()
        exp = np.quantile(vals, [0.25, 0.5, 0.75])
        assert np.allclose([row["q0"], row["q1"], row["q2"]], exp, rtol=0, atol=1e-9)


def test_no_global_window_in_rank_plan(spark):
    df, _ = _frame(spark, n=500)
    plan_text = global_rank(df, ["monetary", "customer_id"], partitions=20)._jdf \
        .queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan_text


def test_salted_join_equals_plain_join(spark):
    from custlytics.plans.skew import hot_keys_by_count, salted_left_join
    big = spark.range(6000).select((F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 50))
                                   .alias("k"), F.col("id").alias("v"))
    small = spark.range(50).select(F.col("id").alias("sk"), (F.col("id") * 10).alias("w"))
    counts = big.groupBy(F.col("k").alias("sk")).agg(F.count("*").alias("n"))
    hot = hot_keys_by_count(counts, "sk", "n", share=0.2)
    assert hot == [1]
    plain = {tuple(r) for r in big.join(small, big.k == small.sk, "left").select("v", "w").collect()}
    salted = salted_left_join(big, small, "k", "sk", hot, splits=8, salt_from=["v"])
    assert {tuple(r) for r in salted.select("v", "w").collect()} == plain
    assert salted.count() == 6000
