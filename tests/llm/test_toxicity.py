"""Toxicity by held-out accuracy, the label model on drawn votes, edge rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_fixtures import SF01, SF1, make_docs  # noqa: F401
from custlytics.llm import toxicity as T


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    return docs, labels, T.fit(docs, labels)


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    rows = T.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert len(rows) > 500
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    tp = sum(r.predicted == r.toxic == 1 for r in rows)
    # the table's labels call some texts toxic that hold nothing of the kind
    assert tp / sum(r.predicted for r in rows) >= 0.98 and tp / sum(r.toxic for r in rows) >= 0.8


def test_learns_nothing_from_held_out_labels(fitted, spark):
    docs, labels, model = fitted
    flipped = labels.withColumn("toxic", F.when(T.remainder(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = T.fit(docs, flipped)
    assert other.names == model.names and np.allclose(other.weights, model.weights) and other.bias == pytest.approx(model.bias)


def test_fold_is_crc32(spark):
    rows = spark.range(200).select("id", T.remainder(F.col("id")).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_label_model_recovers_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    votes = np.column_stack([rng.random(4000) < np.where(y, hi, lo) for hi, lo in [(0.8, 0.02), (0.6, 0.1), (0.5, 0.05)]]).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])            # a copy of the first voter
    given = np.where(rng.random(4000) < 0.1, ~y, y).astype(float)
    post, (hi, lo, share) = T.label_model(votes, given)
    assert hi[1] == pytest.approx(0.6, abs=0.07) and lo[1] == pytest.approx(0.1, abs=0.04)
    assert share[0] < 0.7 and share[3] < 0.7 and share[1] > 0.9
    assert ((post > 0.5) == y).mean() > (given == y).mean()


def test_edge_rows(fitted, make_docs, spark):
    _, labels, model = fitted
    bad = " ".join(n[1:] for n in model.names if n.startswith("="))
    rows = [(1, None), (2, ""), (3, "123 !!"), (None, bad), (4, bad), (4, bad), (5, "a plain text about nothing")]
    out = T.score(make_docs(rows, extra={"score": "clash", "toxic": 1}), model).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 7 and got[1].score == got[2].score == got[3].score < 0.5 and got[4].predicted == 1 and got[5].predicted == 0
    assert got[None].held_out and got[None].score == got[4].score
    assert T.score(make_docs([]), model).count() == 0
    none = T.fit(make_docs(rows), labels.limit(0))
    assert {r.score for r in T.score(make_docs(rows), none).collect()} == {0.0}
    odd = spark.createDataFrame([(1, None), (None, 1), (77, 1), (5, 0), (5, 0)], "doc_id long, toxic int")
    assert T.score(make_docs(rows), T.fit(make_docs(rows), odd)).count() == 7


def test_registered_query_equals_plain_python(spark):
    """The whole table, scored with the fitted weights text by text, without the number finder."""
    from custlytics.llm.queries import op5_toxicity
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = T.fit(docs, spark.read.parquet(f"{SF01}/labels.parquet"))
    weight = dict(zip(model.names, model.weights, strict=True))
    want = {}
    for r in docs.select("doc_id", "text").collect():
        z = model.bias + sum(weight.get(f, 0.0) for f in T.features(r.text))
        want[r.doc_id] = (zlib.crc32(str(r.doc_id).encode()) % 5 == 0, 1 / (1 + np.exp(-z)))
    rows = op5_toxicity(spark, SF01).collect()
    assert len(rows) == len(want)
    for r in rows:
        held, score = want[r.doc_id]
        assert r.held_out == held and r.score == pytest.approx(score, abs=1e-9) and r.predicted == (r.score >= 0.5)


def test_very_long_text(fitted, make_docs):
    """The one telling word at the end of three megabytes counts as at the start."""
    model = fitted[2]
    word = next(n[1:] for n in model.names if n.startswith("="))
    filler = "123 456 " * 400_000
    got = {r.doc_id: r.score for r in T.score(make_docs([(1, filler + word), (2, word), (3, filler)]), model).collect()}
    assert got[1] == got[2] != got[3]


def test_small_table(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    assert T.score(docs, T.fit(docs, spark.read.parquet(f"{SF01}/labels.parquet"))).count() == 1000
