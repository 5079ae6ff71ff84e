"""Vector search against all pairs."""

import math
import random

import numpy as np
import pytest

from corpus_fixtures import SF1
from custlytics.llm import ann as A

SCHEMA = "vec_id long, embedding array<double>"


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))


def answers(spark, rows, **options):
    vecs = A.vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    out = A.search(vecs, vecs.where("vec_id % 50 = 0"), **options).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


@pytest.mark.parametrize("options", [{}, {"list_rows": 100}])
def test_recall_on_a_whole_table(spark, options):
    """At the registered settings, and with shorter lists."""
    vecs = A.vectors(spark.read.parquet(f"{SF1}/embeddings.parquet"), "vec_id", "embedding")
    got = A.search(vecs, vecs.where("vec_id % 50 = 0"), **options).collect()
    table = vecs.toPandas()
    x = np.stack(table["vec"].to_numpy())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = table["vec_id"].to_numpy()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        best = ids[np.argsort(-s, kind="stable")[:5]]
        hits += sum(b in found[ids[q]] for b in best)
        total += 5
        for v, score in found[ids[q]].items():
            assert score == pytest.approx(float(s[np.flatnonzero(ids == v)[0]]), abs=1e-12)
    assert len(found) == (ids % 50 == 0).sum() and hits / total >= 0.9


def test_common_vectors_tie_by_id(spark):
    rng = random.Random(1)
    same = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, list(same) if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(8)]) for i in range(3000)]
    got = answers(spark, rows, list_rows=50)
    assert [v for _, v, _ in got[0]] == [3, 6, 9, 12, 15] and [v for _, v, _ in got[150]] == [0, 3, 6, 9, 12]
    assert all(len(x) == 5 and [r for r, _, _ in x] == [1, 2, 3, 4, 5] for x in got.values())


def test_edge_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]),
            (100, [float("inf"), 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (1, [2.0, 0.0]), (8, [1e200, 1e200]), (9, [-1.0, 0.0])]
    got = answers(spark, rows)
    assert set(got) == {0, 50}
    assert [v for _, v, _ in got[0]] == [1, 8, 50, 9]         # 8 and 50 tie
    assert got[0][0][2] == 1.0 and got[0][-1][2] == -1.0
    assert {v for _, v, _ in got[50]} == {0, 1, 8, 9}
    assert answers(spark, [(0, [1.0, 0.0])]) == {} and answers(spark, [(0, None)]) == {}


def test_graph_finds_the_lists_a_full_scan_would():
    rng = np.random.default_rng(2)
    x = A._unit(rng.normal(size=(3000, 16)))
    c = A.Centroids(x, 60)
    assert np.bincount((x @ c.c.T).argmax(axis=1)).max() < 4 * 3000 / len(c.c)
    missed = total = 0
    for q in A._unit(rng.normal(size=(100, 16))):
        d = A._distances(q[None], c.c)[0]
        want = set(np.flatnonzero(d <= 1.25 * d.min()).tolist())
        missed += len(want - set(c.search(q, 0.25)))
        total += len(want)
    assert missed / total < 0.01


def test_boundary_vectors_are_replicated():
    rng = np.random.default_rng(3)
    x = A._unit(rng.normal(size=(500, 8)))
    c = A.Centroids(x, 10)
    lists = c.lists(x, 0.1)
    assert all(p[0] == int(np.argmin(A._distances(v[None], c.c)[0])) for p, v in zip(lists, x)) and sum(len(p) > 1 for p in lists) > 50


@pytest.mark.parametrize("spread, least, most", [(0.5, 0.9, 0.05), (2.0, 0.9, 1.3)])
def test_tuned_lists_prune_where_vectors_cluster(spread, least, most):
    """40,000 vectors of 64 dimensions: recall, and rows scanned a query as a share of the table."""
    rng = np.random.default_rng(8)
    x = A._unit(rng.normal(size=(400, 64))[rng.integers(0, 400, 40_000)] + spread * rng.normal(size=(40_000, 64)))
    c = A.Centroids(x[:A.SAMPLE_ROWS], len(x) // A.LIST_ROWS)
    boundary, ratio = A.tune(c, x[:A.SAMPLE_ROWS])
    lists = c.lists(x, boundary)
    sizes = np.bincount([j for own in lists for j in own], minlength=len(c.c))
    hits = scanned = 0
    asked = range(39, len(x), 200)
    for q in asked:
        s = x @ x[q]
        s[q] = -2
        probed = set(c.search(x[q], ratio))
        hits += sum(bool(probed & set(lists[i])) for i in np.argpartition(-s, 5)[:5])
        scanned += sizes[list(probed)].sum()
    assert hits / (5 * len(asked)) >= least and scanned / len(asked) / len(x) < most


def test_tune_takes_small_and_equal_samples():
    for x in (np.ones((1, 3)), np.ones((400, 3)), np.eye(3), np.r_[np.ones((300, 3)), np.eye(3)]):
        c = A.Centroids(A._unit(x), 3)
        boundary, ratio = A.tune(c, A._unit(x))
        assert boundary in A.BOUNDARIES and ratio in A.RATIOS


def test_columns_of_clashing_names(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)], SCHEMA)
    extra = df.selectExpr("vec_id", "embedding", "'x' AS vec", "1 AS list", "2 AS place", "3 AS score", "4 AS rank", "5 AS id", "6 AS query_id")
    want, got = (A.vectors(t, "vec_id", "embedding") for t in (df, extra))
    want, got = (sorted(map(tuple, A.search(v, v.where("vec_id % 50 = 0"), list_rows=20).collect())) for v in (want, got))
    assert got == want and len(got) == 20


def test_repeated_rows_do_not_crowd_out_other_ids(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    once = answers(spark, rows, list_rows=200)
    near = [(7, list(rows[0][1]))] * 6                       # one id fills a whole cut
    assert answers(spark, rows * 2, list_rows=400) == answers(spark, rows, list_rows=400) and all(len(x) == 5 for x in once.values())
    got = answers(spark, [r for r in rows if r[0] != 7] + near, list_rows=400)
    assert got[0] == answers(spark, [r for r in rows if r[0] != 7] + near[:1], list_rows=400)[0] and len(got[0]) == 5


def test_an_id_of_several_vectors_takes_one_place():
    rng = np.random.default_rng(5)
    q, others = np.array([[1.0, 0.0, 0.0]]), rng.normal(size=(20, 3))
    many = np.array([[1.0, 0.001 * k, 0.0] for k in range(8)])
    ids = np.r_[np.full(8, 100), np.arange(1, 21)]
    _, got, scores = A._best(q, np.array([0]), np.array([-2.0]), np.concatenate([many, others]), ids, 5)
    want = sorted([(-1.0, 100)] + [(-cosine(q[0], x), i) for i, x in enumerate(others.tolist(), 1)])[:5]
    assert got == [i for _, i in want] and scores == pytest.approx([-s for s, _ in want], abs=1e-12)


def test_short_queries_go_to_the_next_lists(spark):
    rng = random.Random(6)
    hot = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, list(hot)) for i in range(1, 1500) if i % 50]
    rows += [(50 * i, [x + rng.gauss(0, 0.01) for x in hot]) for i in range(8)]          # distinct neighbours of the hot vector
    rows += [(2000 + i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)]
    got = answers(spark, rows, list_rows=50)
    assert set(got) == {i for i, _ in rows if i % 50 == 0}
    assert all([r for r, _, _ in x] == [1, 2, 3, 4, 5] for x in got.values())


def test_every_list_is_scanned_before_a_query_stays_short(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(0, 60)]
    alone = answers(spark, rows, list_rows=1, boundary=0.0)  # a list a vector
    assert set(alone) == {0, 50} and all(len(x) == 5 for x in alone.values())
    got = answers(spark, rows, list_rows=1, boundary=0.0, top=100)
    for q, x in got.items():
        assert [v for _, v, _ in x] == [i for i, _ in sorted(rows, key=lambda r: -cosine(r[1], rows[q][1])) if i != q]
