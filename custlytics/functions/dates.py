"""Calendar helpers.

Every day difference is a difference of calendar dates (time of day is
dropped first), so a purchase at 23:59 and one at 00:01 on the same day are
zero days apart.  Months are handled as an integer key ``year*12 + month-1``
inside plans and rendered as ``yyyy-MM`` only for output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def day(c) -> Column:
    """Calendar date of a date/timestamp column."""
    return F.to_date(_c(c))


def days_between(later, earlier) -> Column:
    """Whole calendar days from ``earlier`` to ``later``."""
    return F.datediff(day(later), day(earlier))


def month_key(c) -> Column:
    """Integer month key; consecutive months differ by one."""
    d = day(c)
    return F.year(d) * 12 + F.month(d) - 1


#: Months that one 64-bit integer holds a bit of; integers beyond which months are collected instead.
WORD_MONTHS, MOST_WORDS = 63, 32


def month_words(c, first: int, last: int) -> list[Column]:
    """Aggregates that hold a bit for each month key from ``first`` to ``last``
    in which ``c`` lies, as 64-bit integers: fixed-size partial results, so the
    aggregation hashes and combines before its shuffle.  Null for no month."""
    at = month_key(c) - first
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at % WORD_MONTHS)
    return [F.bit_or(F.when(F.floor(at / WORD_MONTHS) == w, bit)) for w in range((last - first) // WORD_MONTHS + 1)]


def count_months(words: list[Column]) -> Column:
    """How many months the words hold."""
    return sum((F.bit_count(F.coalesce(w, F.lit(0).cast("bigint"))) for w in words), F.lit(0))


def months_of(words: list[Column], first: int, last: int) -> Column:
    """The month keys that the words hold, ascending."""
    held = F.array(*[F.coalesce(w, F.lit(0).cast("bigint")) for w in words])
    places = F.sequence(F.lit(0), F.lit(last - first))
    here = F.filter(places, lambda i: F.call_function("getbit", F.element_at(held, F.floor(i / WORD_MONTHS).cast("int") + 1), i % WORD_MONTHS) == 1)
    return F.transform(here, lambda i: i + first)


def month_label(key) -> Column:
    """``yyyy-MM`` text of a month key (null for null)."""
    k = _c(key)
    return F.when(k.isNotNull(), F.format_string("%04d-%02d", F.floor(k / 12).cast("int"), (k % 12 + 1).cast("int")))
