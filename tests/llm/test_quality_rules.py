"""Quality rules against DuckDB SQL and plain Python."""

import duckdb
import pandas as pd

from corpus_fixtures import make_docs  # noqa: F401
from custlytics.llm import quality_rules as Q

EDGE = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one two three"), (5, "a b c d e f g h i j"), (6, "x " * 40),
    (7, "the quick brown fox jumps over the lazy dog again and again"), (8, "w#*$ " * 12), (9, "same line here\nsame line here\n\nother"),
    (10, "STOP!! NOW!! " * 10), (11, "été où là bas " * 4), (12, "- a b c d\n- e f g h\n- i j k l"), (13, "wait...\nmore…\nend of it all now ok yes no"),
    (None, "null id with more than ten words in it to pass the rule"), (7, "the quick brown fox jumps over the lazy dog again and again"),
    (14, "a b c d e a b c d e z"), (15, "\x0ba b\x0cc d e f g h i j k"), (16, ("word%d " * 60) % tuple(range(60))),
]


def brute(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(Q.SPACES):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum((text or "").count(c) for c in Q.SYMBOLS), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_counts_by_hand(make_docs):
    got = Q.measure(make_docs(EDGE)).collect()
    assert sorted(((r.doc_id or -1), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(
        ((d or -1), *brute(t)) for d, t in EDGE)
    assert all(not r.kept for r in got if r.base_failed)


def test_equals_sql(make_docs):
    docs = make_docs(EDGE)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(EDGE, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}).assign(lang="en"))
    want = sorted(map(repr, con.execute(Q.duckdb_sql()).fetchall()))
    assert sorted(repr(tuple(r)) for r in Q.measure(docs).collect()) == want


def test_keep_good_keeps_columns(make_docs):
    docs = make_docs(EDGE, extra={"n_words": "mine", "kept": 5, "words": None})
    out = Q.keep_good(docs)
    assert out.columns == docs.columns
    good = {r.doc_id for r in Q.measure(make_docs(EDGE)).collect() if r.kept}
    rows = out.collect()
    assert {r.doc_id for r in rows} == good and {7, None} <= good and all(r.n_words == "mine" for r in rows)
    assert Q.keep_good(docs.limit(0)).count() == 0 and Q.measure(docs.limit(0)).count() == 0


def test_stop_words_only_in_listed_languages(spark):
    other = "Сегодня утром мы вышли из дома рано и долго шли вдоль реки к старому мосту. " * 1 + " ".join(f"слово{i}" for i in range(60))
    plain = " ".join(f"word{i}" for i in range(60))
    langs = ["ru", "en", "EN", "en-GB", "en_US", "", None, "e n", "eng", "english", "de"]
    rows = [(i, t, x) for i, (t, x) in enumerate([(other, "ru"), *[(plain, x) for x in langs]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in Q.measure(docs).collect()}
    assert got[0].kept and {rows[i][2] for i, r in got.items() if not r.kept} == {"en", "EN", "en-GB", "en_US", "de"}
    assert {r.doc_id for r in Q.keep_good(docs).collect()} == {i for i, r in got.items() if r.kept}
    assert not any(r.kept for r in Q.measure(docs, lang=None).collect())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang"]))
    assert sorted(map(repr, con.execute(Q.duckdb_sql()).fetchall())) == sorted(repr(tuple(r)) for r in Q.measure(docs).collect())


def test_very_long_text(make_docs):
    text = " ".join(f"{w} the{i} of" for i, w in enumerate(["alpha", "beta", "gamma"] * 20_000))
    (r,) = Q.measure(make_docs([(1, text)])).collect()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text)


def test_plan_is_projections_only(make_docs):
    plan = Q.measure(make_docs(EDGE))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow", "Join"))
