"""Exact money arithmetic.

Money and rates are summed as decimals of SCALE decimals, which hold every
amount in use exactly, and rounded half-up once, from the sum: the sum is the
same in any order and on any engine.  Sums reach 10^21 (an overflow is an error
in Spark, not a wrong number)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Decimals of a single amount or rate.
SCALE = 8


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def total_units(c) -> Column:
    """The sum of amounts or rates as an integer number of units of 10**-SCALE."""
    total = F.sum(_c(c).cast(f"decimal(28,{SCALE})")).cast(f"decimal(29,{SCALE})")
    return (total * F.lit(10 ** SCALE).cast("decimal(9,0)")).cast("decimal(38,0)")


def units_to_cents(c) -> Column:
    """Units of money as integer cents, rounded half-up."""
    return half_up_div(c, F.lit(10 ** (SCALE - 2)), "decimal(38,0)")


def cents(c) -> Column:
    """Money (double with 2 decimals) as integer cents."""
    return F.round(_c(c) * 100).cast("bigint")


def int_div(num, den, kind: str = "bigint") -> Column:
    """Exact floor division of non-negative integers (decimal arithmetic, so
    no double rounding even past 2**53)."""
    a = _c(num).cast("decimal(38,0)")
    b = _c(den).cast("decimal(38,0)")
    return ((a - F.pmod(a, b)) / b).cast(kind)


def half_up_div(num, den, kind: str = "bigint") -> Column:
    """Integer ``num / den`` rounded half away from zero (``den`` > 0)."""
    n, d = _c(num), _c(den)
    return (F.signum(n).cast("bigint") * int_div(F.abs(n) * 2 + d, d * 2, kind)).cast(kind)


def from_cents(c) -> Column:
    return _c(c).cast("double") / 100


def from_micros(c, scale: int = 1000000) -> Column:
    return _c(c).cast("double") / scale


def exact_mean(total, count, scale_in: int = 0, decimals: int = 6) -> Column:
    """Mean of integers given in units of 10**-scale_in, rounded half-up to
    ``decimals`` places from exact integer arithmetic, as double."""
    shift = decimals - scale_in
    num = _c(total).cast("decimal(38,0)") * F.lit(10 ** shift).cast("decimal(38,0)")
    return from_micros(half_up_div(num, _c(count)), 10 ** decimals)
