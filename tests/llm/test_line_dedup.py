"""Line deduplication against all pairs of lines."""

import hashlib
import random

import pytest

from corpus_fixtures import make_docs  # noqa: F401
from custlytics.llm import line_dedup as L
from custlytics.llm.quality_rules import SPACES


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, max_edits, min_chars):
    lines = [(d, n, x.strip(SPACES)) for d, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    first = {}
    for d, n, x in sorted(lines):
        if len(x) >= min_chars:
            first.setdefault(x, (d, n))
    gone = {x for x, p in first.items() if any(q < p and abs(len(x) - len(y)) <= max_edits and edits(x, y) <= max_edits
                                               for y, q in first.items() if y != x)}
    out = {}
    for d, t in rows:
        if t is None:
            out[d] = (None, 0, 0)
            continue
        raw = t.split("\n")
        kept = [x for n, x in enumerate(raw) if len(x.strip(SPACES)) < min_chars or (
            first[x.strip(SPACES)] == (d, n) and x.strip(SPACES) not in gone)]
        out[d] = ("\n".join(kept), len(raw), len(raw) - len(kept))
    return out


@pytest.mark.parametrize("max_edits", [0, 1, 2, 3])
def test_random_lines(make_docs, max_edits):
    rng = random.Random(max_edits)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(6, 24))) for _ in range(25)]

    def change(x):
        x = list(x)
        for _ in range(rng.randint(0, max_edits + 1)):
            at, kind = rng.randrange(len(x) + 1), rng.random()
            if kind < 0.4:
                x.insert(at, rng.choice("abz"))
            elif x and kind < 0.7:
                x[min(at, len(x) - 1)] = rng.choice("abz")
            elif x:
                del x[min(at, len(x) - 1)]
        return "".join(x)

    rows = [(i, "\n".join(change(rng.choice(base)) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in L.dedup_lines(make_docs(rows), max_edits=max_edits, min_chars=5).collect()}
    assert got == brute(rows, max_edits, 5)


def test_segments_cover_a_line(spark):
    from pyspark.sql import functions as F
    df = spark.range(4, 40).select(F.col("id").cast("int").alias("n"))
    for parts in (1, 2, 3, 4):
        cols = [c for i in range(parts) for c in L._segment(F.col("n"), i, parts)]
        for row in df.select("n", *[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect():
            at = 0
            for i in range(parts):
                assert row[1 + 2 * i] == at and row[2 + 2 * i] >= 1
                at += row[2 + 2 * i]
            assert at == row.n


def test_edge_rows(make_docs):
    line = "a passage that is long enough to count as a line"
    rows = [(1, None), (2, ""), (3, line), (4, line + "\nshort\n" + line), (5, "  " + line + "\t"), (None, line + "!"), (6, "short\nshort")]
    out = L.dedup_lines(make_docs(rows, extra={"n_lines": "clash", "lines": 1, "h1": 2}))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_chars) for r in out.collect()}
    assert got[1] == (None, 0, 0, None) and got[2] == ("", 1, 0, 0) and got[6] == ("short\nshort", 2, 0, 11)
    assert got[None][0] == line + "!"                       # null ids come first
    assert got[3][0] == "" and got[4][:3] == ("short", 3, 2) and got[5][0] == ""
    kept = L.drop_repeated_lines(make_docs(rows))
    assert {r.doc_id for r in kept.collect()} == {1, 2, 4, 6, None} and kept.columns == make_docs(rows).columns
    assert L.dedup_lines(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        L.dedup_lines(make_docs(rows), max_edits=3, min_chars=3)


def test_equal_rows_keep_the_same_lines(make_docs):
    line = "a passage that is long enough to count as a line"
    got = L.dedup_lines(make_docs([(1, line), (1, line), (2, line)])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, line), (1, line), (2, "")]


def test_places_beyond_the_broadcast_bound(make_docs, monkeypatch):
    rows = [(i, "\n".join(f"line {(i * k) % 17} of the passage number {k % 5}" for k in range(9))) for i in range(40)]
    want = sorted(map(tuple, L.dedup_lines(make_docs(rows)).collect()))
    monkeypatch.setattr(L, "BROADCAST_PLACES", 0)
    assert sorted(map(tuple, L.dedup_lines(make_docs(rows)).collect())) == want


def test_very_long_text_and_line(make_docs):
    """A line of 50,000 characters, one edit from another, and a text of 2,000 lines."""
    long = " ".join(f"word{i}" for i in range(6_000))
    many = "\n".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(2_000))
    rows = [(1, long), (2, long + "!"), (3, many), (4, many)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in L.dedup_lines(make_docs(rows)).collect()}
    assert got == {1: (long, 1, 0), 2: ("", 1, 1), 3: (many, 2_000, 0), 4: ("", 2_000, 2_000)}


def test_no_python_in_the_plan(make_docs):
    plan = L.dedup_lines(make_docs([(1, "x" * 50), (2, "x" * 51)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
