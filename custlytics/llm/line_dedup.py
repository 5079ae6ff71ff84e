"""Line deduplication: a segment-partition edit-distance join over the lines
of a corpus, in DataFrame expressions only.

A line (trimmed, ``min_chars`` code points or more) goes if an earlier line
lies within ``max_edits`` edits, or if it repeats one; "earlier" is by
``doc_id`` (null first), row hash and line number, and counts lines that go
themselves.  Shorter lines always stay.

1. Lines are hashed (128 bits) where they stand; one aggregation finds the
   first occurrence of each, so copies of a line cost one counted row.
2. A first occurrence of length ``l`` is cut into ``max_edits + 1`` segments;
   within ``max_edits`` edits one of them survives.  Index rows carry
   (length, segment number, segment) of a line; probe rows carry the
   substrings of a line, for each length up to ``max_edits`` shorter and each
   segment, whose shift the remaining edits allow.
3. Lines that meet on a key join only if their counts of some letters allow
   that few edits (an edit moves two counts by one at most), so lines that
   share a segment and differ elsewhere make no rows; the rest are compared by
   Spark's banded ``levenshtein`` with a threshold (a bit-parallel kernel has
   no column expression).
4. Each document is joined with the numbers of its surviving first
   occurrences and rebuilt from them.

Defined results: a null text stays null; an empty text stays; the same row
(id and text) twice keeps the same lines in both; other columns are carried,
``n_chars`` (if there) becomes the new length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlytics.llm.quality_rules import SPACES
from custlytics.llm.tables import settled
from custlytics.session import materialize_table

MAX_EDITS, MIN_CHARS = 1, 30
#: Letters counted for the letter filter (any would do), bits of a count.
LETTERS, COUNT_BITS = "eantor", 10
#: Lines to verify up to which their places are broadcast (about 40 bytes each).
BROADCAST_PLACES = 1_000_000


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def _row_id() -> Column:
    return F.xxhash64("doc_id", "text")


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of an even cut: the last ones
    are longer by one where the length does not divide."""
    short = F.floor(length / parts).cast("int")
    longer = length - short * parts                       # this many segments have one more
    before = F.greatest(F.lit(0), longer - (parts - i))
    return short * i + before, short + F.when(F.lit(parts - i) <= longer, 1).otherwise(0)


def _key(line: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(line, start + 1, size))


def index_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """Keys a line is found by: one for each of its segments."""
    return [_key(line, length, i, *_segment(length, i, edits + 1)) for i in range(edits + 1)]


def probe_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """Keys of the substrings at which a line of this or a smaller length can
    have kept a segment: a shift is bounded by the edits on its left and, with
    the difference in length, by the edits on its right."""
    keys = []
    for less in range(edits + 1):
        other = length - less
        for i in range(edits + 1):
            start, size = _segment(other, i, edits + 1)
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                at = start + shift
                keys.append(F.when((at >= 0) & (at + size <= length), _key(line, other, i, at, size)))
    return keys


def _letters(line: Column) -> Column:
    """Counts of some letters, packed; each modulo 2 ** COUNT_BITS."""
    packed = F.lit(0).cast("long")
    for k, x in enumerate(LETTERS):
        count = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(x), F.lit("")))).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(count.bitwiseAND((1 << COUNT_BITS) - 1), COUNT_BITS * k))
    return packed


def _letters_allow(a: Column, b: Column, edits: int) -> Column:
    total = F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        x, y = (F.shiftright(c, COUNT_BITS * k).bitwiseAND((1 << COUNT_BITS) - 1) for c in (a, b))
        total = total + F.least(F.abs(x - y), F.lit(1 << COUNT_BITS) - F.abs(x - y))
    return total <= 2 * edits


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, rid, ln, line of the lines that take part."""
    rows = docs.select("doc_id", _row_id().alias("rid"), F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return rows.withColumn("line", _trim(F.col("line"))).where(F.length("line") >= min_chars)


def _near(first: DataFrame, docs: DataFrame, edits: int) -> DataFrame:
    """``h1``, ``h2`` of the lines that an earlier line lies close to."""
    lists = first.groupBy("doc_id", "rid").agg(F.collect_list("ln").alias("lns"))
    texts = docs.select(F.col("doc_id").alias("d"), _row_id().alias("r"), F.split("text", "\n").alias("lines"))
    lines = lists.join(texts, (F.col("rid") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")))
    lines = lines.select(F.explode(F.transform("lns", lambda i: F.get("lines", i))).alias("line"))
    lines = lines.select(_trim(F.col("line")).alias("line")).withColumn("len", F.length("line"))
    line, length = F.col("line"), F.col("len")
    keyed = lines.select(F.xxhash64("line").alias("h"), _letters(line).alias("letters"),
                         F.array(*index_keys(line, length, edits)).alias("idx"),
                         F.array_distinct(F.array_compact(F.array(*probe_keys(line, length, edits)))).alias("probe"))
    rows = keyed.select("h", "letters", F.explode(F.concat(
        F.transform("idx", lambda k: F.struct(k.alias("key"), F.lit(True).alias("indexed"))),
        F.transform("probe", lambda k: F.struct(k.alias("key"), F.lit(False).alias("indexed"))))).alias("e"))
    rows = materialize_table(rows.select("h", "letters", "e.key", "e.indexed"), "segments")
    left = rows.where("indexed").select(F.col("h").alias("ha"), "key", F.col("letters").alias("la"))
    right = rows.where("NOT indexed").select(F.col("h").alias("hb"), F.col("key").alias("k"), F.col("letters").alias("lb"))
    pairs = left.join(right, (F.col("key") == F.col("k")) & (F.col("ha") != F.col("hb")) & _letters_allow(
        F.col("la"), F.col("lb"), edits)).select(
        F.least("ha", "hb").alias("ha"), F.greatest("ha", "hb").alias("hb")).distinct()
    pairs = materialize_table(pairs, "pairs")

    # texts of the lines to compare, from their first occurrences
    wanted = pairs.select(F.col("ha").alias("h1")).union(pairs.select("hb")).distinct()
    places = materialize_table(first.join(wanted, "h1", "left_semi").select("doc_id", "rid", "ln", "h1", "h2"), "places")
    lists = places.groupBy(F.col("doc_id").alias("d"), F.col("rid").alias("r")).agg(F.collect_list(F.struct("ln", "h1", "h2")).alias("at"))
    if places.count() <= BROADCAST_PLACES:
        lists = F.broadcast(lists)
    found = docs.select("doc_id", _row_id().alias("rid"), F.split("text", "\n").alias("lines")).join(
        lists, (F.col("rid") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")))
    found = found.select("doc_id", "rid", F.explode("at").alias("at"), "lines").select(
        "at.h1", "at.h2", F.struct("doc_id", "rid", F.col("at.ln").alias("ln")).alias("place"),
        _trim(F.get("lines", F.col("at.ln"))).alias("line")).dropDuplicates(["h1", "h2"])
    found = materialize_table(found, "texts")
    a = found.select(F.col("h1").alias("ha"), F.col("place").alias("pa"), F.col("line").alias("la"), F.col("h2").alias("a2"))
    b = found.select(F.col("h1").alias("hb"), F.col("place").alias("pb"), F.col("line").alias("lb"), F.col("h2").alias("b2"))
    close = pairs.join(a, "ha").join(b, "hb").where(F.levenshtein("la", "lb", edits) >= 0)
    a_later = F.col("pa") > F.col("pb")
    return close.select(F.when(a_later, F.col("ha")).otherwise(F.col("hb")).alias("h1"),
                        F.when(a_later, F.col("a2")).otherwise(F.col("b2")).alias("h2")).distinct()


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The input rows with ``text`` rebuilt from the lines that stay, and
    ``n_lines``, ``n_removed`` (bigint) appended."""
    if min_chars <= max_edits:
        raise ValueError("min_chars must exceed max_edits: every segment needs a character")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = _lines(slim, min_chars).select("doc_id", "rid", "ln", F.xxhash64("line").alias("h1"),
                                          F.xxhash64(F.lit(17), F.reverse("line")).alias("h2"))
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "rid", "ln")).alias("p"))
    first = materialize_table(first.select("h1", "h2", "p.doc_id", "p.rid", "p.ln"), "firsts")
    near = materialize_table(_near(first, slim, max_edits), "near")
    kept = first.join(near, ["h1", "h2"], "left_anti").groupBy(
        F.col("doc_id").alias("__d"), F.col("rid").alias("__r")).agg(F.collect_list("ln").alias("__keep"))

    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names],
                       F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("__rid"))
    rows = rows.join(kept, (F.col("__rid") == F.col("__r")) & F.col(f"`{doc_id}`").eqNullSafe(F.col("__d")), "left")
    rows = rows.withColumn("__lines", F.split(F.col(f"`{text}`"), "\n"))
    # short lines stay; the numbers of all that stay, in order
    rows = rows.withColumn("__short", F.filter(
        F.transform("__lines", lambda x, i: F.when(F.length(_trim(x)) < min_chars, i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("__all", F.sort_array(F.concat(
        "__short", F.coalesce("__keep", F.array().cast("array<int>")))))
    rows = rows.withColumn("__new", F.array_join(F.transform("__all", lambda i: F.get("__lines", i)), "\n"))
    out = []
    for c in names:
        if c == text:
            out.append(F.col("__new").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("__new").isNull(), F.col("n_chars")).otherwise(
                F.length("__new").cast(docs.schema["n_chars"].dataType)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    size = F.coalesce(F.size("__lines"), F.lit(0))
    return rows.select(*out, F.when(F.col("__lines").isNull(), 0).otherwise(size).cast("long").alias("n_lines"),
                       F.when(F.col("__lines").isNull(), 0).otherwise(size - F.size("__all")).cast("long").alias("n_removed"))


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """:func:`dedup_lines` with the input's columns; documents that lost lines
    and have no text left go."""
    text = options.get("text", "text")
    out = dedup_lines(docs, **options)
    left = (F.col("n_removed") == 0) | (_trim(F.col(f"`{text}`")) != "")
    return settled(out, docs.columns, "__left", left).where("__left").select(*[F.col(f"`{c}`") for c in docs.columns])


def duckdb_sql(table: str = "documents", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> str:
    """doc_id, text, n_lines, n_removed in DuckDB SQL (one row an id)."""
    strip = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    return f"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ln,
                  unnest(string_split(text, chr(10))) AS raw FROM {table}),
t AS (SELECT *, trim(raw, {strip}) AS line FROM l),
f AS (SELECT line, min((doc_id, ln)) AS place, length(line) AS n FROM t WHERE length(line) >= {min_chars} GROUP BY line),
near AS (SELECT DISTINCT b.line FROM f a JOIN f b ON b.n BETWEEN a.n - {max_edits} AND a.n + {max_edits} AND a.place < b.place
         WHERE levenshtein(a.line, b.line) <= {max_edits}),
k AS (SELECT t.doc_id, t.ln, t.raw, (t.line IS NULL OR length(t.line) < {min_chars} OR
             (f.place = (t.doc_id, t.ln) AND t.line NOT IN (SELECT line FROM near))) AS stays
      FROM t LEFT JOIN f USING (line)),
r AS (SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY ln) FILTER (stays), '') AS text, count(*) AS n_lines,
             count(*) FILTER (NOT stays) AS n_removed FROM k GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE r.text END AS text,
       coalesce(r.n_lines, 0)::BIGINT AS n_lines, coalesce(r.n_removed, 0)::BIGINT AS n_removed
FROM {table} d LEFT JOIN r USING (doc_id)"""
