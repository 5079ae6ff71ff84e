"""Toxicity scores by weak supervision.

1. Voters: words (lexicon) and word beginnings (patterns) that mark labelled
   texts as toxic, found by counting a bounded sample of labelled rows.
2. Label model: a generative model in which a text is toxic or not and each
   voter fires with a rate of its own in either case; the rates (accuracies)
   are estimated by expectation-maximisation, the given label being one more
   voter of unknown accuracy.  Correlations between voters of a class are
   estimated alongside, and voters that fire together share one vote.
3. Classifier: a linear model on all counted features, trained on the
   posterior labels, scores every text.

Only the text is an input of a score.  Labels are learned only from rows whose
``crc32(doc_id) mod 5`` is not 0.

Defined results: null, empty and wordless texts score the classifier's bias;
rows without a ``doc_id`` count as held out; labels that are null, or whose
text is missing, are skipped; a label that occurs twice counts twice; with no
labelled rows of both classes every score is 0; an empty table gives an empty
result; other columns are not read."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlytics.session import materialize_table

#: Labelled rows that the model is fitted on (taken in hash order), features
#: of the classifier, voters of the label model, lengths of word beginnings.
SAMPLE_ROWS, FEATURES, VOTERS, STEMS = 20_000, 1_024, 64, (4, 5, 6)
#: Least texts a feature occurs in, and least ratio of its class rates.
SUPPORT, LIFT = 3, 3.0
#: Correlation from which voters share a vote.
SHARED = 0.5
FOLDS = 5

WORD = re.compile(r"[^\W\d_]+")


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def features(text: str | None) -> set[str]:
    """Words (``=word``) and their beginnings (``stem*``) of a text."""
    out = set()
    for w in set(WORD.findall((text or "").lower())):
        out.add("=" + w)
        out.update(w[:k] + "*" for k in STEMS if len(w) > k)
    return out


class Finder:
    """Numbers of the known features in a text."""

    def __init__(self, names: list[str]):
        self.number = {n: i for i, n in enumerate(names)}
        # words are looked at only if they begin like some feature
        self.heads = {n.strip("=*")[:STEMS[0]] for n in names}

    def __call__(self, text: str | None) -> list[int]:
        heads, cut, found = self.heads, STEMS[0], set()
        for w in set(WORD.findall((text or "").lower())):
            if w[:cut] in heads:
                found.update(i for n in ("=" + w, *(w[:k] + "*" for k in STEMS if len(w) > k))
                             if (i := self.number.get(n)) is not None)
        return sorted(found)


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    bias: float
    voters: list[str]
    fire_if_toxic: np.ndarray
    fire_if_clean: np.ndarray
    share: np.ndarray                                        # of a vote, below 1 for correlated voters
    rows: int

    def score(self, numbers: list[int]) -> float:
        z = self.bias + float(self.weights[numbers].sum())
        return float(1.0 / (1.0 + np.exp(-max(-500.0, z)))) if np.isfinite(self.bias) else 0.0


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``text``, ``y`` of at most ``rows`` labelled rows, materialised."""
    some = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("y")).where(
        "__id IS NOT NULL AND y IS NOT NULL").where(remainder(F.col("__id")) != 0)
    some = some.orderBy(F.xxhash64("__id"), "__id", "y").limit(rows)
    return materialize_table(docs.join(F.broadcast(some), F.col("doc_id") == F.col("__id")).select("text", "y"), "labelled")


def _vocabulary(sample: DataFrame) -> list[str]:
    """The features that mark toxic texts best, most telling first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y == 1].update(features(text))
        names = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(names), 50_000):
            some = names[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([seen[1][n] for n in some], pa.int64()),
                                              pa.array([seen[0][n] for n in some], pa.int64())], names=["name", "t", "c"])

    sizes = {r["y"] == 1: r["count"] for r in sample.groupBy((F.col("y") == 1).cast("int").alias("y")).count().collect()}
    if len(sizes) < 2:
        return []
    counted = sample.mapInArrow(count, "name string, t bigint, c bigint").groupBy("name").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") >= SUPPORT)
    lift = ((F.col("t") + 0.5) / sizes[True]) / ((F.col("c") + 0.5) / sizes[False])
    best = counted.withColumn("lift", lift).where(F.col("lift") >= LIFT)
    rows = best.orderBy((F.col("t") * F.log("lift")).desc(), "name").limit(FEATURES).select("name").collect()
    return [r["name"] for r in rows]


def _found(sample: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix (rows x names, 0/1) and labels of the bounded sample."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([finder(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())),
                                              batch.column(1)], names=["numbers", "y"])

    rows = sample.mapInArrow(find, "numbers array<int>, y int").toArrow()
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, numbers in enumerate(rows.column("numbers").to_pylist()):
        x[i, numbers] = 1.0
    return x, rows.column("y").to_numpy().astype(np.float64)


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, tuple]:
    """Posterior of "toxic" for each row, and (rate if toxic, rate if clean,
    share of a vote) of each voter; the given label is the last voter."""
    v = np.column_stack([votes, given]).astype(np.float64)
    post = np.clip(given, 0.05, 0.95)
    share = np.ones(v.shape[1])
    for _ in range(rounds):
        t, c = post.sum() + 2.0, (1 - post).sum() + 2.0
        hi = np.clip((post @ v + 1.0) / t, 1e-4, 1 - 1e-4)
        lo = np.clip(((1 - post) @ v + 1.0) / c, 1e-4, 1 - 1e-4)
        # correlation of two voters within the classes: voters that fire
        # together beyond what the label explains share a vote
        off = v - np.outer(post, hi) - np.outer(1 - post, lo)
        spread = np.sqrt((off * off).sum(axis=0)) + 1e-9
        corr = np.abs(off.T @ off) / np.outer(spread, spread)
        share = 1.0 / np.maximum(1.0, np.where(corr >= SHARED, corr, 0.0).sum(axis=1))
        odds = np.log(t / c) + v @ (share * np.log(hi / lo)) + (1 - v) @ (share * np.log((1 - hi) / (1 - lo)))
        post = 1.0 / (1.0 + np.exp(-np.clip(odds, -30, 30)))
    return post, (hi, lo, share)


def linear(x: np.ndarray, target: np.ndarray, rounds: int = 800, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Adam over the whole sample."""
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, rounds + 1):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = ((p - target) / len(target)).astype(np.float32)
        g = np.append(x.T @ d + decay * w, d.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** k)) / (np.sqrt(s / (1 - 0.999 ** k)) + 1e-8)
        w -= step[:-1].astype(np.float32)
        b -= float(step[-1])
    return w.astype(np.float64), b


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = _sample(docs, labels, sample_rows)
    names = _vocabulary(sample)
    if not names:
        return Model([], np.zeros(0), -np.inf, [], np.zeros(0), np.zeros(0), np.zeros(0), 0)
    x, given = _found(sample, names)
    post, (hi, lo, share) = label_model(x[:, :VOTERS], given)
    weights, bias = linear(x, post)
    return Model(names, weights, bias, names[:VOTERS], hi, lo, share, len(x))


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.names)
        for batch in batches:
            scores = [model.score(finder(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score",
                      F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
