"""URL filter against DuckDB SQL, plain Python and planted urls."""

import re

import duckdb

from corpus_fixtures import SF01
from custlytics.llm import url_filter as U


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    if best:
        return host, path, best[0], best[1]
    words = set(re.split("[^a-z0-9]+", host + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in path)))
    bad = words & set(U.STRICT) or len(words & set(U.SOFT)) >= U.SOFT_LIMIT
    return host, path, None, "block" if bad else "allow"


def judged(spark, rows, **options):
    out = U.judge(spark.createDataFrame(rows, "page_id long, url string"), **options).collect()
    return sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out], key=repr)


def test_equals_sql_and_plain(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet").select("page_id", "url")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF01}/pages.parquet')")
    want = sorted(con.execute(U.duckdb_sql()).fetchall())
    got = U.judge(pages).select("page_id", *U.RESULTS).collect()
    assert sorted(tuple(r) for r in got) == want
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id])


ODD = [
    None, "", "no scheme", "://", "http://", "https://A.NET/x", "https://a.net", "https://a.net?x=/", "https://net/", "https://xnet/",
    "https://example.net/en/", "https://EXAMPLE.net/EN/", "https://sub.example.net/en/1", "https://myexample.net/en/1",
    "http://example.com/de/a", "http://example.com/deep", "http://a.org/fr/1", "http://org/fr/casino", "http://a.org/casino?x",
    "http://a.org/?q=casino", "http://a.org/#casino", "http://a.org/casinos-x", "http://a.org/mycasino", "http://a.org/casinò/casino",
    "http://free.org/free-free", "http://free.org/pills", "http://a.org/free_bets", "http://a.org/freebets/éfreeé/winé",
    "a://b://c.net/", "http://user:pw@a.net:80/x", "http://a.org/CASINO", "http://a.com/line\nbreak/xxx", "http://a.com/" + "ab/" * 200_000 + "porn",
    "http://a.com/" + "free-" * 100_000, "http://ADULT-x.example.org/en/1", "http://a.com/x", "http://Ａ.com/ＣＡＳＩＮＯ"]


def test_odd_urls(spark):
    rows = [(i, u) for i, u in enumerate(ODD)] + [(None, "http://casino.com/"), (3, "://"), (3, "://")]
    want = sorted([(i, *plain(u)) for i, u in rows], key=repr)
    assert judged(spark, rows) == want


def test_boundaries_and_limits(spark):
    one = dict(rules=(), strict=("bad word", "a"), soft=("b", "bb", "a"))
    rows = [(1, "x://h/bad word"), (2, "x://h/bad words"), (3, "x://h/b-bb"), (4, "x://h/bbb"), (5, "x://h/b/b"), (6, "x://a")]
    assert [r[4] for r in judged(spark, rows, **one)] == ["block", "allow", "block", "allow", "allow", "block"]
    assert [r[4] for r in judged(spark, rows, soft_limit=1, **one)] == ["block", "allow", "block", "allow", "block", "block"]


def test_overlapping_terms():
    auto = U.automaton((), ("free", "free-bets", "bets"))
    assert U.count_terms("free-bets", auto) == (0, 3)
    assert U.count_terms("", auto) == (0, 0)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(df).count() == 0
    odd = spark.createDataFrame([(1, "http://casino.com/", "keep", "old", "old", 2)],
                                "page_id long, url string, `a.b` string, host string, verdict string, strict_hits int")
    row = U.judge(odd).first()
    assert row["a.b"] == "keep" and row.host == "casino.com" and row.verdict == "block" and row.strict_hits == 1
    kept = U.keep_allowed(odd.unionByName(odd.selectExpr("2 page_id", "'http://fine.com/' url", "`a.b`", "host", "verdict", "strict_hits")))
    assert kept.columns == odd.columns and [(r.page_id, r.host) for r in kept.collect()] == [(2, "old")]


def test_planted_hosts(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet").select("page_id", "url")
    out = U.judge(pages).where("rule IS NULL")
    names = "ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm"
    assert {r.verdict for r in out.where(out.host.rlike(names)).collect()} == {"block"}
    assert {r.verdict for r in out.where(~out.host.rlike(names)).collect()} == {"allow"}
