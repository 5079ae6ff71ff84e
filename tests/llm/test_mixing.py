"""Source mixing against DuckDB SQL and by invariants."""

import math
from collections import Counter

import duckdb
import pandas as pd
import pytest

from corpus_fixtures import make_docs  # noqa: F401
from custlytics.llm import mixing as M


def corpus():
    rows = []
    for k, n in enumerate([400, 90, 40, 7, 1]):
        rows += [(len(rows) + i, "w " * (1 + (i * 7) % 13), f"s{k}") for i in range(n)]
    return rows


def shown(docs, target=M.Target(), **options):
    return M.mix(docs, target, **options).select("doc_id", "source", "n_tokens", "epoch", "block", "block_rank").collect()


def shares(rows):
    t = Counter()
    for r in rows:
        t[r.source] += r.n_tokens
    total = sum(t.values())
    return {s: x / total for s, x in t.items()}


def test_equals_sql(make_docs):
    rows = corpus() + [(9000, None, "s0"), (9001, " ", None), (None, "a b c", None)]
    docs = make_docs(rows)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    for repeats in (1.5, 2.0, 4.0):
        want = sorted(map(repr, con.execute(M.duckdb_sql(max_repeats=repeats, blocks=16)).fetchall()))
        assert sorted(repr(tuple(r)) for r in shown(docs, M.Target(max_repeats=repeats), blocks=16)) == want


def test_every_document_is_shown_and_repeats_stay_within_the_limit(make_docs):
    rows = corpus()
    got = shown(make_docs(rows), M.Target(max_repeats=3.0), blocks=8)
    times = Counter(r.doc_id for r in got)
    assert set(times) == {r[0] for r in rows} and max(times.values()) <= 3
    total, quota = Counter(), Counter()
    for r in rows:
        total[r[2]] += len(r[1].split())
    for r in got:
        quota[r.source] += r.n_tokens
    assert all(quota[s] <= 3.0 * total[s] + 1e-6 for s in total)
    assert quota["s0"] == total["s0"]                        # the largest source is shown once
    assert quota["s4"] >= 2.9 * total["s4"] - 13             # the smallest as often as allowed


def test_entropy_target(make_docs):
    docs = make_docs(corpus())
    for goal in (1.2, 1.5):
        got = shares(shown(docs, M.Target(max_repeats=None, target_entropy=goal), blocks=64))
        assert -sum(p * math.log(p) for p in got.values()) == pytest.approx(goal, abs=0.03)


def test_token_budget_is_kept(make_docs):
    docs = make_docs(corpus())
    for budget in (300, 2000, 6000):
        got = shown(docs, M.Target(max_repeats=5.0, budget=budget), blocks=8)
        used = sum(r.n_tokens for r in got)
        assert used <= budget and used >= budget - 13 * 5 - 5


def test_order_within_an_epoch_is_a_permutation_of_blocks(make_docs):
    got = shown(make_docs(corpus()), M.Target(max_repeats=2.0), blocks=8)
    ranks = {}
    for r in got:
        ranks.setdefault((r.source, r.epoch), {}).setdefault(r.block_rank, set()).add(r.block)
    assert all(all(len(b) == 1 for b in x.values()) for x in ranks.values())
    assert len({tuple(next(iter(x[k])) for k in sorted(x)) for (s, _), x in ranks.items() if s == "s1"}) > 1


def test_edge_rows(make_docs):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (None, "x y", None), (5, "x y", "b"), (5, "x y", "b")]
    out = M.mix(make_docs(rows, extra={"epoch": "clash", "tokens": 1, "left": 2, "t": 3, "p": 4}))
    got = sorted((r.doc_id or -1, r.source or "", r.n_tokens) for r in out.where("epoch = 0").collect())
    assert got == sorted((d or -1, s or "", len((t or "").split())) for d, t, s in rows)
    assert M.mix(make_docs([])).count() == 0 and M.mix(make_docs([(1, None)])).count() == 1
    one = shown(make_docs([(1, "a b", "only")] * 3))
    assert len(one) == 3
    with pytest.raises(ValueError):
        M.Target(max_repeats=2.0, target_entropy=1.0)


def test_very_long_text(make_docs):
    """One text holds almost all tokens of its source; it is counted whole and shown as a whole."""
    rows = [(1, "w " * 500_000, "a"), *[(i, "x y z", "a") for i in range(2, 20)], *[(i, "p q", "b") for i in range(20, 40)]]
    got = shown(make_docs(rows))
    assert {r.doc_id for r in got if r.epoch == 0} == {r[0] for r in rows}
    assert {r.n_tokens for r in got if r.doc_id == 1} == {500_000}
