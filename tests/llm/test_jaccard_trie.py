"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from brute import components as brute
from corpus_fixtures import SF001, make_docs  # noqa: F401
from custlytics.llm import jaccard_trie as J
from custlytics.llm.components import components


def found(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(docs, **options).collect()}


def families(seed):
    """Groups of edited copies, documents around one common passage, chains."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(250)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 9, 40, 90, 300]))]
        for _ in range(rng.choice([1, 2, 6, 20])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy + ["end"] * rng.choice([0, 0, 1, 3])))
    passage = [rng.choice(words) for _ in range(50)]
    rows += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(3, 25))]) for _ in range(40)]
    walk = [rng.choice(words) for _ in range(80)]
    for _ in range(25):                                      # each like the one before, far from the first
        walk = walk[3:] + [rng.choice(words) for _ in range(3)]
        rows.append(" ".join(walk))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_families_chains_and_passages(make_docs, seed):
    rows = families(seed)
    got, want = found(make_docs(rows)), brute(rows)
    assert got == want
    assert sum(k != c for k, (_, c) in want.items()) > 50
    assert sorted(r.doc_id for r in J.keep_one(make_docs(rows)).collect()) == sorted(k for k, (_, c) in want.items() if k == c)


def test_other_similarity(make_docs):
    rows = families(3)[:150]
    assert found(make_docs(rows), percent=60) == brute(rows, 60)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_rows(make_docs):
    text = "the one text that has more than five words in it"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Few WORDS"), (9, "few words"), (8, "few"), (5, text), (6, text.upper()), (7, text + " é" * 3000)]
    assert found(make_docs(rows, extra={"n": 1, "node": "clash", "shingle": 0, "label": None})) == brute(rows)
    assert found(make_docs([])) == {} and found(make_docs([(1, None)])) == {1: (0, 1)}
    kept = J.keep_one(make_docs(rows, extra={"node": "mine"}))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 8] and kept.columns[-1] == "node"


def test_repeated_and_null_ids(make_docs):
    text = "the one text that has more than five words in it"
    rows = [(3, text), (3, text), (3, "another text with the same id of five words"), (None, text), (None, "no id and no copy has this text of words"),
            (None, "no id and no copy has this text of words"), (5, text), (None, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in J.near_duplicates(make_docs(rows)).collect())
    assert got == sorted([(3, 7, 3), (3, 7, 3), (3, 5, 3), (-1, 7, 3), (-1, 6, -1), (-1, 6, -1), (5, 7, 3), (-1, 0, -1)])
    kept = sorted((r.doc_id or -1, r.text or "") for r in J.keep_one(make_docs(rows)).collect())
    assert kept == sorted([(3, text), (3, rows[2][1]), (-1, rows[4][1]), (-1, "")])


def test_a_group_that_shares_all_but_links_nothing(make_docs):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    assert found(make_docs(rows)) == brute(rows)


def test_trie_walk_equals_sets():
    rng = np.random.default_rng(6)
    probe = rng.choice(200, 60, replace=False).astype(np.uint64)
    walk = J.TrieWalk(probe, 80)
    seqs = []
    for _ in range(400):
        s = probe.copy()
        swap = rng.random(len(s)) < rng.choice([0.0, 0.05, 0.1, 0.3])
        s[swap] = rng.integers(200, 400, swap.sum())
        seqs.append(np.array(list(dict.fromkeys(s[:rng.integers(30, 61)].tolist())), np.uint64))
    for s in sorted(seqs, key=lambda s: s.astype(">u8").tobytes()):
        a, b = set(probe.tolist()), set(s.tolist())
        assert walk.links(s) == (100 * len(a & b) >= 80 * len(a | b))


def test_components_of_chains_rings_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 300), (300, 200), (-5, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, -5: -5, 200: -5, 300: -5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
