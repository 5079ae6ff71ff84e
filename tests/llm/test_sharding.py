"""Extendible hashing against DuckDB SQL and by its invariants."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from corpus_fixtures import SF001, make_docs  # noqa: F401
from custlytics.llm import sharding as S


def test_equals_sql(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    for limit in (3_000, 40_000, 1 << 24):
        want = sorted(con.execute(S.duckdb_sql(limit=limit)).fetchall())
        got = S.assign(docs.select("doc_id", "text"), limit).drop("text")
        assert sorted(tuple(r) for r in got.collect()) == want
        assert got.columns == [c[0] for c in con.description]


def check(rows, limit):
    """Every shard fits (or is one document), names no other's bits, and could not be shorter."""
    size, docs, told = Counter(), Counter(), {}
    for r in rows:
        size[r.shard] += r.doc_bytes
        docs[r.shard] += 1
        told[r.shard] = (r.shard_bytes, r.shard_docs)
    assert all(size[s] <= limit or docs[s] == 1 for s in size)
    assert all(told[s] == (size[s], docs[s]) for s in size)
    plain = sorted({s.split(".")[0] for s in size})
    assert not any(b.startswith(a) for a, b in zip(plain, plain[1:]))
    return size, docs


@pytest.mark.parametrize("limit", [300, 2_000])
def test_sizes(make_docs, limit):
    rows = [(i, "x" * ((i * 37) % 120)) for i in range(800)] + [(900, "y" * 5000)]
    out = S.assign(make_docs(rows, extra={"shard": "clash", "cell": 1, "n_bytes": 2}), limit)
    check(out.collect(), limit)
    assert out.where("doc_id = 900").first().shard_docs == 1


def test_more_shards_than_first_bits(make_docs, monkeypatch):
    monkeypatch.setattr(S, "FIRST_BITS", 3)
    monkeypatch.setattr(S, "FINER", 1)
    rows = [(i, "x" * 50) for i in range(600)]
    size, _ = check(S.assign(make_docs(rows), 200).collect(), 200)
    assert len(size) > 150


def test_hot_id_and_equal_rows_split(make_docs):
    rows = [(7, f"text {i} " + "z" * 40) for i in range(300)] + [(8, "w" * 60)] * 500 + [(i, "v" * 30) for i in range(100, 200)]
    out = S.assign(make_docs(rows), 1_000).collect()
    size, docs = check(out, 1_000)
    assert len(out) == 900 and sum("." in s for s in size) == -(-500 // (1_000 // 60))


def test_edge_rows(make_docs):
    rows = [(None, "a"), (None, None), (1, ""), (2, None), (2, None)]
    out = S.assign(make_docs(rows), 1_000).collect()
    check(out, 1_000)
    assert len(out) == 5 and {r.shard for r in out} == {""}
    assert S.assign(make_docs([]), 1_000).count() == 0
    with_null = S.assign(make_docs([(None, "q" * 700)] * 4), 1_000).collect()
    assert len(check(with_null, 1_000)[0]) == 4


def test_written_shards(make_docs, spark, tmp_path):
    docs = make_docs([(i, "x" * 100) for i in range(200)])
    path = str(tmp_path / "s")
    S.write_shards(docs, path, 3_000)
    folders = glob.glob(path + "/shard=*")
    assert len(folders) > 4 and all(len(glob.glob(f + "/*.parquet")) == 1 for f in folders)
    back = spark.read.parquet(path)
    assert back.count() == 200 and os.path.isdir(path)
