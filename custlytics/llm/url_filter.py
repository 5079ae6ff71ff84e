"""URL filter: domain rules, then a weighted vocabulary.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, A-Z lower-cased; its path is what follows up to ``?``, ``#`` or the end.
A rule (host, path, verdict) fits its host and every subdomain if the url's
path starts with the rule's; the longest fitting rule (host and path together,
ties to the smaller) decides.  Without a rule an Aho-Corasick automaton finds
the vocabulary's terms in host and path, A-Z lower-cased, in one pass; a term
counts only between boundaries (no letter or digit on either side).  One
strict term rejects, and so do ``SOFT_LIMIT`` distinct soft terms.

Host, path and rule are Spark expressions; only the vocabulary runs in Python,
on Arrow batches, without a shuffle: a hot host costs what its rows cost.

Defined results: a null url or one without ``://`` has empty host and path, no
rule and the verdict ``allow``; a rule whose path is ``/`` does not fit a url
without a path; ports and user names are part of the host; repeated rows and
null ids come out as they went in, a row each; an empty table gives no rows;
other columns are kept by :func:`judge` unless named like a result, whose
place the result takes."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ----------------------------------------------------------
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Terms one of which rejects a url: words that name what is sold and little else.
STRICT = (
    "bestiality", "blackjack", "camgirl", "camgirls", "camsex", "casino", "casinos", "escort", "escorts", "fetish",
    "gambling", "hardcore", "hentai", "jackpot", "livesex", "milf", "milfs", "nsfw", "nude", "nudes", "payday",
    "phishing", "porn", "porno", "pornhub", "porns", "roulette", "slots", "sportsbook", "tube8", "viagra", "cialis",
    "warez", "xhamster", "xnxx", "xvideos", "xxx")
#: Terms that say little alone; several distinct ones reject.
SOFT = (
    "ad", "ads", "adult", "adults", "advert", "adverts", "affiliate", "amateur", "babe", "babes", "banner", "bet",
    "bets", "betting", "bonus", "cam", "cams", "cash", "cheap", "click", "clicks", "coupon", "coupons", "crack",
    "cracked", "dating", "deal", "deals", "discount", "download", "downloads", "drugs", "earn", "farm", "farms",
    "free", "girls", "hack", "hot", "jackpots", "keygen", "link", "links", "loan", "loans", "lotto", "lottery",
    "meds", "money", "naked", "offer", "offers", "pharma", "pharmacy", "pill", "pills", "pirate", "poker", "pop",
    "popup", "prize", "prizes", "promo", "proxy", "rich", "seo", "serial", "sex", "sexy", "spam", "spin", "spins",
    "stream", "teen", "teens", "torrent", "torrents", "track", "tracker", "trackers", "tracking", "traffic",
    "weight", "win", "winner", "winners", "wins", "x", "xx")
# ----------------------------------------------------------------------------
#: Distinct soft terms that reject.
SOFT_LIMIT = 2

RESULTS = ["host", "path", "rule", "strict_hits", "soft_hits", "verdict"]


@functools.lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    """Aho-Corasick automaton whose words carry (term, is strict)."""
    import ahocorasick
    auto = ahocorasick.Automaton()
    for t in soft:
        auto.add_word(t, (t, False))
    for t in strict:                                        # a term in both lists is strict
        auto.add_word(t, (t, True))
    auto.make_automaton()
    return auto


def _edge(c: str) -> bool:
    """Whether a character bounds a term: no ASCII letter or digit."""
    return not ("a" <= c <= "z" or "0" <= c <= "9")


def count_terms(text: str, auto) -> tuple[int, int]:
    """Distinct strict and soft terms of a lower-cased text."""
    strict, soft, n = set(), set(), len(text)
    for end, (term, hard) in auto.iter(text):
        start = end - len(term)
        if (start < 0 or _edge(text[start])) and (end + 1 == n or _edge(text[end + 1])):
            (strict if hard else soft).add(term)
    return len(strict), len(soft)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _by_length(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))


def pick_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(_by_length(rules)):             # the longest is tested first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, *, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
          strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """The rows of ``pages`` with host, path, rule, strict_hits, soft_hits
    (distinct terms; null where a rule decided) and verdict."""
    if any(t != t.lower() or not t for t in (*strict, *soft)):
        raise ValueError("terms must be lower-cased and not empty")
    terms = (tuple(strict), tuple(soft))
    keep = [c for c in pages.columns if c not in RESULTS]
    rows = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    rule, verdict = pick_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    at, schema = len(keep), rows.drop("verdict").schema
    schema = schema.add("strict_hits", "integer").add("soft_hits", "integer").add("verdict", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(*terms)
        for batch in batches:
            hard: list[int | None] = []
            mild: list[int | None] = []
            told: list[str] = []
            for h, p, v in zip(*(batch.column(i).to_pylist() for i in (at, at + 1, at + 3)), strict=True):
                a, b = (None, None) if v else count_terms(h + p.translate(_LOWER), auto)
                hard.append(a)
                mild.append(b)
                told.append(v or ("block" if a or b >= soft_limit else "allow"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at + 3], pa.array(hard, pa.int32()), pa.array(mild, pa.int32()), pa.array(told, pa.string())],
                names=schema.fieldNames())

    return rows.mapInArrow(run, schema).toDF(*keep, *RESULTS)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def keep_allowed(pages: DataFrame, *, url: str = "url", **options) -> DataFrame:
    """The rows of ``pages`` whose url passes, as they are."""
    places = [f"c{i}" for i in range(len(pages.columns))]
    judged = judge(pages.toDF(*places), url=places[pages.columns.index(url)], **options)
    return judged.where("verdict = 'allow'").select(*places).toDF(*pages.columns)


def duckdb_sql(table: str = "pages") -> str:
    """page_id, host, path, rule, strict_hits, soft_hits, verdict in DuckDB SQL."""
    def hits(terms):
        return " + ".join(f"regexp_matches(s, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT" for t in terms)
    longest = _by_length(RULES)
    fits = [f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for h, p, _ in longest]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, longest))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, longest))
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM {table}),
h AS (SELECT page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruled,
             host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM h),
v AS (SELECT *, CASE WHEN ruled IS NULL THEN {hits(STRICT)} END AS strict_hits, CASE WHEN ruled IS NULL THEN {hits(SOFT)} END AS soft_hits FROM r)
SELECT page_id, host, path, rule, strict_hits::INTEGER AS strict_hits, soft_hits::INTEGER AS soft_hits,
       coalesce(ruled, CASE WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM v"""
