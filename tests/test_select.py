"""Rows located by counting equal the rows of a sorted list."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlytics.operators import select as S


def places(n):
    return sorted({0, n // 4, n // 2, (n * 3) // 4, n - 1})


def check(spark, rows, schema, order, key):
    """The rows after each boundary are those after that place in the sorted list."""
    df = spark.createDataFrame(rows, schema)
    want = sorted(rows, key=key)
    found = S.boundaries(df, order, {(): places(len(rows))}, {(): len(rows)})
    for at in places(len(rows)):
        late = df.where(S.after(df, order, found[(), at])).collect()
        assert sorted(map(repr, map(tuple, late))) == sorted(map(repr, want[at + 1:])), at


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ties_on_every_column(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 1, 1, 2, 7, rng.randrange(50)]), rng.choice([5.0, 5.0, round(rng.random() * 100, 2)])) for i in range(900)]
    rng.shuffle(rows)
    check(spark, rows, "customer_id long, frequency long, monetary double",
          [("frequency", True), ("monetary", False), ("customer_id", True)], lambda r: (r[1], -r[2], r[0]))


def test_one_value_for_all_and_text_ids(spark):
    rng = random.Random(4)
    names = [f"C{k:0{rng.choice([3, 9, 14])}d}" + rng.choice(["", "é", "z"]) for k in rng.sample(range(10_000), 700)]
    rows = [(n, 3) for n in names]
    check(spark, rows, "customer_id string, frequency int", [("frequency", True), ("customer_id", True)], lambda r: r[0].encode())


def test_nulls_first_up_and_last_down(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 11)) for i in range(300)]
    check(spark, rows, "id long, v double", [("v", True), ("id", True)], lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    check(spark, rows, "id long, v double", [("v", False), ("id", True)], lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))


def test_ids_beyond_the_exact_doubles(spark):
    rows = [((1 << 60) + i * 3 - (i % 2) * (1 << 61),) for i in range(400)]
    check(spark, rows, "id long", [("id", True)], lambda r: r[0])


def test_narrowing_rounds_agree(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW_ROWS", 3)                    # many rounds of splitting
    monkeypatch.setattr(S, "ACCURACY", 20)
    rng = np.random.default_rng(5)
    v = np.round(rng.exponential(10, 2000), 1)
    df = spark.createDataFrame([(int(i), float(x), int(i % 3)) for i, x in enumerate(v)], "id long, v double, g int")
    sizes = {(r.g,): r["count"] for r in df.groupBy("g").count().collect()}
    found = S.locate(df, "v", {g: places(n) for g, n in sizes.items()}, sizes, ["g"])
    for (g,), n in sizes.items():
        mine = np.sort(v[np.arange(2000) % 3 == g])
        for at in places(n):
            x, below, same = found[(g,), at]
            assert x == mine[at] and below == (mine < x).sum() and same == (mine == x).sum()


def test_no_sort_or_shuffle_of_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("id"), (F.col("id") % 7).alias("v"))
    found = S.boundaries(df, [("v", True), ("id", True)], {(): [2500]}, {(): 5000})
    text = df.withColumn("late", S.after(df, [("v", True), ("id", True)], found[(), 2500]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Exchange", "Sort", "Window", "Join"))
