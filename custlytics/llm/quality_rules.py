"""Quality rules: a threshold table compiled into one Spark projection.

Each rule compares an integer count with an integer share of another count
(``100 * numerator`` against ``percent * denominator``), so verdicts carry no
floating-point rounding.  Everything is built-in column expressions; the plan
is one scan and projections, without a shuffle or user function.

Defined results for edge cases: a null text has no words and fails the base
rule (fewer than ten words); an empty text likewise; a null ``doc_id`` stays
null; repeated rows are judged each on its own; extra columns are ignored by
:func:`measure` and kept by :func:`keep_good`, whose scratch columns carry a
prefix and cannot clash with the caller's.  The share of stop words is judged
only where ``lang`` names a language of the list (a region after ``-`` or
``_`` and case do not matter): texts of other languages, or of none, are not
held to it.  A table without such a column passes ``lang=None`` and has every
text judged by it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlytics.llm.tables import settled

#: Word separators (fixed values): the six ASCII white-space characters.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Common function words of the corpus languages (fixed values).
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be at by this have from or an not but",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur",
    "es": "de la que el en y los se del las un por con no una su para es al lo como",
}

P = "__qr_"


@dataclass(frozen=True)
class Rule:
    """``low``/``high`` percent bounds on ``100 * part / whole``; applied to
    texts of ``min_words`` words or more, and with ``listed`` only to those in
    a language of ``STOP_WORDS``."""
    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    min_words: int = 0
    listed: bool = False


#: The threshold table.  Bounds are wide of what clean prose shows.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbol_ratio", "n_symbols", "n_words", high=30),
    Rule("shout_ratio", "n_shouts", "n_words", high=60),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=3, min_words=50, listed=True),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", high=40),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", high=90),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", high=40),
)

#: Base rule (fixed values): fewest words, percent of words in repeated windows.
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_stop_words", "n_shouts", "n_lines", "n_bullet_lines", "n_ellipsis_lines"]


def stop_words() -> list[str]:
    return sorted({w for words in STOP_WORDS.values() for w in words.split()})


def _size(c: Column) -> Column:
    return F.size(c).cast("long")


def _repeat_words(windows: str) -> Column:
    """Words covered by windows that occur twice or more, from the sorted
    ``(hash, position)`` array: equal neighbours mark repeated windows, and
    each marked position adds the words the previous one did not cover."""
    s = F.col(windows)
    m = F.size(s)
    pairs = F.zip_with(F.slice(s, F.lit(1), F.greatest(m - 1, F.lit(0))),
                       F.slice(s, F.lit(2), F.greatest(m - 1, F.lit(0))),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    marked = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    start = F.struct(F.lit(-WINDOW).cast("int").alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        marked, start,
        lambda acc, p: F.struct(p.alias("last"),
                                (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"]).cast("long")).alias("n")),
        lambda acc: acc["n"])


def _listed(lang: str | None) -> Column:
    if lang is None:
        return F.lit(True)
    return F.coalesce(F.lower(F.regexp_extract(F.col(lang).cast("string"), "^[A-Za-z]+", 0)).isin(sorted(STOP_WORDS)), F.lit(False))


def with_counts(df: DataFrame, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Append the counts the rules need, each as ``__qr_<count>``, and
    ``__qr_listed``: the language has stop words here."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACES))
    df = df.withColumn(P + "words", F.when(trimmed == "", F.array().cast("array<string>"))
                       .otherwise(F.split(trimmed, SPACE_RUN)))
    df = df.withColumns({
        P + "hashes": F.transform(F.col(P + "words"), lambda w: F.xxhash64(w)),
        P + "lines": F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
    })
    hashes = F.col(P + "hashes")
    last = F.size(hashes) - (WINDOW - 1)
    df = df.withColumn(P + "windows", F.sort_array(F.when(last < 1, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1),
                    lambda i: F.struct(F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]).alias("h"),
                                       i.alias("i"))))))
    words, lines = F.col(P + "words"), F.col(P + "lines")
    stops = stop_words()
    return df.withColumns({
        P + "listed": _listed(lang),
        P + "n_words": _size(words),
        P + "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        P + "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        P + "n_dup_lines": _size(lines) - _size(F.array_distinct(lines)),
        P + "n_repeat_words": _repeat_words(P + "windows"),
        P + "n_stop_words": _size(F.filter(words, lambda w: F.lower(w).isin(stops))),
        P + "n_shouts": (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long"),
        P + "n_lines": _size(lines),
        P + "n_bullet_lines": _size(F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)).rlike("^[-*•]"))),
        P + "n_ellipsis_lines": _size(F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)).rlike("(\\.\\.\\.|…)$"))),
    }).drop(P + "words", P + "hashes", P + "lines", P + "windows")


def _fails(rule: Rule) -> Column:
    part, whole = F.col(P + rule.part) * 100, F.col(P + rule.whole)
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (part < whole * rule.low)
    if rule.high is not None:
        bad = bad | (part > whole * rule.high)
    if rule.listed:
        bad = bad & F.col(P + "listed")
    return bad & (F.col(P + "n_words") >= rule.min_words)


def base_failed() -> Column:
    n = F.col(P + "n_words")
    return (n < MIN_WORDS) | (F.col(P + "n_repeat_words") * 100 > n * REPEAT_PERCENT)


def verdicts(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules a row fails, as one array column."""
    return F.array_compact(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rules]))


def measure(df: DataFrame, text: str = "text", doc_id: str = "doc_id",
            rules: tuple[Rule, ...] = RULES, lang: str | None = "lang") -> DataFrame:
    """One row per input row: counts, ``base_failed``, ``failed_rules``, ``kept``."""
    tongue = [] if lang is None else [F.col(lang).alias("lang")]
    df = with_counts(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *tongue), "text", lang and "lang")
    df = df.withColumns({P + "base": base_failed(), P + "failed": verdicts(rules)})
    return df.select(
        "doc_id", *[F.col(P + c).alias(c) for c in COUNTS[:5]],
        F.col(P + "base").alias("base_failed"),
        (~F.col(P + "base") & (F.size(P + "failed") == 0)).alias("kept"),
        *[F.col(P + c).alias(c) for c in COUNTS[5:]],
        F.array_join(P + "failed", ",").alias("failed_rules"))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, lang: str | None = "lang") -> DataFrame:
    """The rows that pass, with their own columns."""
    good = ~base_failed() & (F.size(verdicts(rules)) == 0)
    return settled(with_counts(df, text, lang), df.columns, P + "good", good).where(P + "good").select(
        *[F.col(f"`{c}`") for c in df.columns])


def duckdb_sql(table: str = "documents") -> str:
    """The same measurements in DuckDB SQL."""
    space = r"'[\x20\x09-\x0D]+'"
    strip = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words())
    tongues = ", ".join(f"'{x}'" for x in sorted(STOP_WORDS))
    checks = []
    for r in RULES:
        parts = ([f"100*{r.part} < {r.low}*{r.whole}"] if r.low is not None else []) + (
            [f"100*{r.part} > {r.high}*{r.whole}"] if r.high is not None else [])
        listed = " AND listed" if r.listed else ""
        checks.append(f"CASE WHEN n_words >= {r.min_words}{listed} AND ({' OR '.join(parts)}) THEN '{r.name}' END")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                  coalesce(lower(regexp_extract(lang, '^[A-Za-z]+')) IN ({tongues}), false) AS listed FROM {table}),
l AS (SELECT *, list_filter(string_split_regex(t, {space}), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: trim(x, {strip}) <> '') AS lines FROM d),
w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM l),
g AS (SELECT rid, i, string_agg(word, ' ') OVER five AS gram, count(*) OVER five AS n
      FROM w WINDOW five AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
r AS (SELECT rid, i FROM g WHERE n = {WINDOW} QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, sum(least({WINDOW}, i - prev)) AS n_repeat_words
      FROM (SELECT rid, i, lag(i, 1, i - {WINDOW}) OVER (PARTITION BY rid ORDER BY i) AS prev FROM r) GROUP BY rid),
m AS (SELECT doc_id, listed, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
             length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_shouts,
             len(lines)::BIGINT AS n_lines,
             len(list_filter(lines, lambda x: regexp_matches(trim(x, {strip}), '^[-*•]')))::BIGINT AS n_bullet_lines,
             len(list_filter(lines, lambda x: regexp_matches(trim(x, {strip}), '(\\.\\.\\.|…)$')))::BIGINT AS n_ellipsis_lines
      FROM l LEFT JOIN c USING (rid)),
f AS (SELECT *, (n_words < {MIN_WORDS} OR 100*n_repeat_words > {REPEAT_PERCENT}*n_words) AS base_failed,
             concat_ws(',', {', '.join(checks)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND failed_rules = '') AS kept, n_stop_words, n_shouts, n_lines, n_bullet_lines,
       n_ellipsis_lines, failed_rules FROM f"""
