"""Merkle manifest against plain Python and DuckDB SQL."""

import hashlib
import zlib

import duckdb
import pytest

from corpus_fixtures import DOCS, SF01, make_docs  # noqa: F401
from custlytics.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return H(*[field(row[c]) for c in M.LEAF_COLUMNS])


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([H(*last[i:i + 3]) for i in range(0, len(last), 3)])
    return out


def path(tree, i):
    steps = []
    for level in tree[:-1]:
        a = i - i % 3
        steps.append((level[a:i], level[i + 1:a + 3]))
        i //= 3
    return steps


def plain(rows):
    """The rows of ``manifest`` for dicts of document columns."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[s]]) for s in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for n, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            steps = path(trees[n], i) + path(top, n)
            now = dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                now["text"] = r["text"].replace("\n", "")
            have = leaf(now)
            for left, right in steps:
                have = H(*left, have, *right)
            proof = H(*[x for left, right in steps for x in left + right])
            out.append((r["doc_id"], leaf(r), trees[n][-1][0], top[-1][0], proof, have, have == top[-1][0]))
    return out


def same(docs):
    got = M.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [r.asDict() for r in docs.select(*M.LEAF_COLUMNS).collect()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(plain(rows), key=repr)


def test_table_equals_plain_and_sql(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    same(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF01}/documents.parquet')")
    assert sorted(con.execute(M.duckdb_sql(heights=8)).fetchall()) == sorted(tuple(r) for r in M.manifest(docs).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_tree_sizes(make_docs, n):
    same(make_docs([(i * 7 % 31, f"a\nb {i}", f"s{i % 2 if n > 5 else 0}") for i in range(n)]))


def test_many_sources_and_a_hot_one(spark, make_docs):
    rows = [(i, f"line {i}\nline", f"host{i % 40}" if i % 3 else "hot") for i in range(400)]
    same(make_docs(rows).repartition(7))


def test_odd_rows(spark):
    rows = [(1, "a\nb", "en", "s", 3), (1, "a\nb", "en", "s", 3), (1, "other", "en", "s", 5), (None, "x\ny", None, None, None), (None, None, None, None, None),
            (4, "", "", "", 0), (5, None, "en", "é", 2), (6, "\n\n", "en", "z\U0001f600", 2), (7, "𝔘\r\n", None, "￿", -1), (-8, "long\n" * 100_000, "en", None, 1)]
    same(spark.createDataFrame(rows, DOCS))


def test_copies_hold_most_rows(make_docs):
    same(make_docs([(5, "same\ntext")] * 200 + [(i, "t") for i in range(20)]))


def test_extra_and_clashing_columns(make_docs):
    docs = make_docs([(i, f"t\n{i}", f"s{i % 3}") for i in range(30)], extra={"tree": 3, "lo": 1, "leaf": "x", "path": "y", "a.b": 1, "__pid": 9})
    same(docs)


def test_empty_table(make_docs, spark):
    assert M.manifest(make_docs([(1, "x")]).where("false")).collect() == []


def test_intervals_nest(make_docs):
    signed = M.build(make_docs([(i, f"t{i}", f"s{i % 2}") for i in range(45)]))
    nodes = signed.nodes().collect()
    for s in ("s0", "s1"):
        mine = [n for n in nodes if n.source == s]
        for height in range(max(n.height for n in mine)):
            for n in (n for n in mine if n.height == height):
                assert sum(u.height == height + 1 and u.lo <= n.lo and n.hi <= u.hi for u in mine) == 1
    assert {(n.lo, n.hi) for n in nodes if n.height == 3} == {(0, 23), (0, 22)}


def test_paths_verify_and_tampering_shows(make_docs):
    out = M.manifest(make_docs([(i, "one\ntwo" if i % 2 else "one two") for i in range(60)])).collect()
    touched = {i for i in range(60) if i % 2 and zlib.crc32(str(i).encode()) % 2 == 0}
    assert {r.doc_id for r in out if not r.verified} == touched and touched
