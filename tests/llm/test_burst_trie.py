"""Burst trie against plain Python and DuckDB SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from corpus_fixtures import SF01
from custlytics.llm import burst_trie as B

ROWS = "conv_id long, turn long, role string, text string"


def plain(rows, rebuilt=True):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append(((t is not None, t or 0), name, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    if rebuilt:
        made = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            made[c] = own.get(c - int(c - 100 * int(c / 100)), [])[:h] + turns[h:]
        own = made
    members = {}
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        mine = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in mine) or 1
        saved[node] = sum(saved[k] for k in mine) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, [])), leaves[node], saved[node],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(own[c]) == len(node)).encode()).hexdigest())
                   for node, m in members.items()), key=repr)


def built(spark, rows, rebuilt=True, **options):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, ROWS)
    convs = B.conversations(df)
    out = B.trie(B.rebuild(convs) if rebuilt else convs, **options)
    assert out.schema.simpleString() == B.NODES.simpleString()
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("limit", [8, 100, 4096])
def test_table(spark, limit):
    df = spark.read.parquet(f"{SF01}/conversations.parquet")
    want = plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert built(spark, df, burst_turns=limit) == want
    if limit == 8:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF01}/conversations.parquet')")
        assert sorted(con.execute(B.duckdb_sql()).fetchall(), key=repr) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_with_hot_prefixes(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-300, 1500), 250):
        size = rng.choice([1, 2, 3, 6, 9])
        hot = rng.random() < 0.5
        for t in range(size):
            rows.append((c, t, rng.choice(["user", "assistant"]) if not hot else "user", "hot" if hot and t < 5 else rng.choice("abc") * rng.randrange(3)))
    for limit in (1, 40, 600):
        assert built(spark, rows, burst_turns=limit) == plain(rows)


def test_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(B, "PIECE_IDS", 7)
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(3)]
    rows += [(c, t, "user", "x" * (t % 5)) for c in (1000, 2000) for t in range(700 + c // 1000)]
    assert built(spark, rows, rebuilt=False, burst_turns=50) == plain(rows, rebuilt=False)


def test_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 2, "a", "bc"), (2, 0, "ab", "c"), (2, 0, "ab", "c"), (2, 0, "ab", "c"),
            (None, 0, "user", "nobody"), (100, 5, "user", "\U0001f600é"), (101, 5, "user", "\U0001f600é"), (102, -1, "r", "t"), (-5, 0, "r", "t"),
            (205, 0, "r", "none of the first"), (7, 0, "user", "long " * 200_000), (8, 0, "user", "long " * 200_000)]
    for limit in (1, 4096):
        assert built(spark, rows, burst_turns=limit) == plain(rows)
        assert built(spark, rows, rebuilt=False, burst_turns=limit) == plain(rows, rebuilt=False)


def test_turnless_conversations_are_members_of_the_root(spark):
    short = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 1][:5]
    rows = [(c, 0, "user", "gone") for c in short]      # the first of the hundred is absent
    assert built(spark, rows) == plain(rows) == [(short[0], 0, None, 5, 0, 1, 0, hashlib.sha256(",".join(map(str, short)).encode()).hexdigest())]


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], ROWS)
    assert built(spark, df) == []
    more = spark.createDataFrame([(i % 9, i, "user", "abc"[i % 3]) for i in range(40)], ROWS)
    clash = more.selectExpr("*", "1 AS path", "'x' AS box", "2 AS n", "3 AS `a.b`", "4 AS depth", "5 AS t")
    assert built(spark, clash, burst_turns=3) == plain([tuple(r) for r in more.collect()])
