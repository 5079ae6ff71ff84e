"""Rows at given positions of a total order, without sorting.

All positions of all orders and groups are found together.  A round is two
jobs: a bounded sample of the rows still in question gives splitters on either
side of each position, and one count by (group, bucket between splitters) tells
exactly which bucket holds it.  A position that falls on a splitter -- a value
that many rows share, or any row of a fully sampled table -- is found; the
others go on inside their bucket, a few hundredths of the rows, until few
enough rows are left to be fetched in one last job.  The sample only speeds the
search up: what is returned was counted.

Every job reads the key columns only and sends a bounded number of rows, so a
third of all rows in one value costs no more than any other.  The splitters of
groups are one broadcast table; callers bound the number of groups.

Columns of an order may be of any sortable type (strings by bytes); nulls come
first ascending and last descending."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in question that are fetched and counted off (for each wanted position).
FEW_ROWS = 2_048
#: Rows sampled in a round, all ranges together; at least LEAST_SAMPLE for each.
ACCURACY, LEAST_SAMPLE = 65_536, 64
#: Standard deviations of the sample by which splitters stand off a position.
STAND_OFF = 4.0

Order = Sequence[tuple[str, bool]]


# Conditions are put together as SQL text: one call to the session for a whole
# condition, however many columns and boundaries it compares.

def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _literal(value, dtype: T.DataType) -> str | None:
    """A driver value as SQL, None for null."""
    if value is None:
        return None
    if isinstance(value, str):
        return f"CAST(X'{value.encode().hex()}' AS STRING)"
    return f"CAST('{value}' AS {dtype.simpleString()})"


def _literals(df: DataFrame, order: Order, values: Sequence) -> list[str | None]:
    return [_literal(v, df.schema[c].dataType) for (c, _), v in zip(order, values, strict=True)]


def _fields(struct: str, order: Order) -> list[str]:
    """The fields of a struct of keys, any of which may be null."""
    return [f"{struct}.{_name(c)}" for c, _ in order]


def _past(c: str, b: str | None, asc: bool, nullable: bool) -> str:
    """Whether a value comes strictly after another (never null)."""
    if b is None:
        return f"({c} IS NOT NULL)" if asc else "false"          # nulls first ascending, last descending
    known = f"coalesce({c} > {b}, false)" if asc else f"coalesce({c} < {b}, {c} IS NULL)"
    if not nullable:
        return known
    return f"(CASE WHEN {b} IS NULL THEN {_past(c, None, asc, False)} ELSE {known} END)"


def _same(c: str, b: str | None) -> str:
    return f"({c} IS NULL)" if b is None else f"({c} <=> {b})"


def _after(order: Order, b: Sequence[str | None], nullable: bool = False) -> str:
    cond = "false"
    for (c, asc), x in reversed(list(zip(order, b, strict=True))):
        cond = f"({_past(_name(c), x, asc, nullable)} OR ({_same(_name(c), x)} AND {cond}))"
    return cond


def _equal(order: Order, b: Sequence[str | None]) -> str:
    return "(" + " AND ".join(_same(_name(c), x) for (c, _), x in zip(order, b, strict=True)) + ")"


def _place(order: Order, points: Sequence[Sequence[str | None]], nullable: bool = False) -> str:
    """2k before the k-th point, 2k+1 on it."""
    return " + ".join(["0", *[f"CASE WHEN {_after(order, b, nullable)} THEN 2 WHEN {_equal(order, b)} THEN 1 ELSE 0 END" for b in points]])


def after(df: DataFrame, order: Order, boundary: Sequence) -> Column:
    """Whether a row comes strictly after a boundary of :func:`boundaries`."""
    return F.expr(_after(order, _literals(df, order, boundary)))


def _sort_key(order: Order):
    """The order as a key of tuples on the driver."""
    def one(x, asc):
        if x is None:
            return (not asc,)                                # nulls first ascending, last descending
        if isinstance(x, str):
            raw = x.encode()
            x = raw if asc else (*(-b for b in raw), 1)
        elif isinstance(x, float) and math.isnan(x):         # the largest
            return (asc, asc, 0.0)
        elif isinstance(x, float):
            return (asc, not asc, x if asc else -x)
        elif not asc:
            x = functools.cmp_to_key(lambda a, b: (b > a) - (b < a))(x)
        return (asc, x)

    directions = [asc for _, asc in order]
    return lambda row: tuple(one(x, asc) for x, asc in zip(row, directions, strict=True))


@dataclass(frozen=True)
class _Range:
    """Rows of a group strictly between two boundaries (None: no bound), in one
    of the orders; ``before`` rows come earlier, ``rows`` lie inside."""
    order: str
    group: tuple
    lo: tuple | None
    hi: tuple | None
    before: int
    rows: int


def find(df: DataFrame, orders: dict[str, Order], wanted: dict[str, dict[tuple, Iterable[int]]],
         sizes: dict[tuple, int], by: Sequence[str] = ()) -> dict[tuple[str, tuple, int], tuple[tuple, int, int]]:
    """For each (order, group, 0-based position): (key tuple there, rows before
    that tuple, rows of that tuple).  ``sizes`` are the groups' row counts."""
    found: dict[tuple[str, tuple, int], tuple[tuple, int, int]] = {}
    todo: dict[tuple[str, tuple, int], _Range] = {
        (o, g, p): _Range(o, g, None, None, 0, sizes[g]) for o, groups in wanted.items() for g, ps in groups.items() for p in ps}
    first, rounds = True, 0
    while any(first or r.rows > FEW_ROWS for r in todo.values()):
        some = {t: r for t, r in todo.items() if first or r.rows > FEW_ROWS}
        splitters = _splitters(df, orders, some, by, rounds)
        for t, r in some.items():
            out = _bucket(t[2], r, *splitters[r])
            if isinstance(out, _Range):
                todo[t] = out
            else:
                found[t] = out
                del todo[t]
        first, rounds = False, rounds + 1
    if todo:
        found.update(_fetch(df, orders, todo, by))
    return found


def _in_ranges(df: DataFrame, order: Order, by: Sequence[str], ranges: list[tuple[int, _Range]],
               points: dict[_Range, list[tuple]] | None = None, rates: dict[_Range, float] | None = None, seed: int = 0) -> DataFrame:
    """Rows of ``df`` that lie in one of the (numbered, disjoint) ranges of an
    order, with ``__range`` and, for ``points``, their ``__bucket`` (2k+1: on
    the k-th point; 2k: before it) or a sample by ``rates``."""
    columns = list(dict.fromkeys([*by, *[c for c, _ in order]]))
    if not by:                                               # a few literals in one projection
        inside, rate, place = [], [], []
        for i, r in ranges:
            bounds = ["true"]
            if r.lo is not None:
                bounds.append(_after(order, _literals(df, order, r.lo)))
            if r.hi is not None:
                b = _literals(df, order, r.hi)
                bounds.append(f"NOT ({_after(order, b)} OR {_equal(order, b)})")
            inside.append(f"WHEN {' AND '.join(bounds)} THEN {i}")
            rate.append(f"WHEN __range = {i} THEN {rates[r] if rates else 1.0}D")
            place.append(f"WHEN __range = {i} THEN {_place(order, [_literals(df, order, p) for p in points[r]] if points else [])}")
        rows = df.select(*[_name(c) for c in columns], F.expr(f"CASE {' '.join(inside)} END").alias("__range")).where("__range IS NOT NULL")
        out = rows.select("*", F.expr(f"CASE {' '.join(rate)} END").alias("__rate"), F.expr(f"CASE {' '.join(place)} END").alias("__bucket"))
    else:                                                    # one broadcast row a range
        key = T.StructType([T.StructField(c, df.schema[c].dataType) for c, _ in order])
        most = max((len(points[r]) for _, r in ranges), default=0) if points else 0
        schema = T.StructType([*[T.StructField(f"__by{i}", df.schema[c].dataType) for i, c in enumerate(by)],
                               T.StructField("__range", T.IntegerType()), T.StructField("__rate", T.DoubleType()),
                               T.StructField("__lo", key), T.StructField("__hi", key),
                               *[T.StructField(f"__at{k}", key) for k in range(most)]])
        table = df.sparkSession.createDataFrame(
            [(*r.group, i, rates[r] if rates else 1.0, r.lo, r.hi, *[points[r][k] if points and k < len(points[r]) else None for k in range(most)])
             for i, r in ranges], schema)
        lo, hi = _fields("__lo", order), _fields("__hi", order)
        mine = " AND ".join([*[f"({_name(c)} <=> __by{i})" for i, c in enumerate(by)],
                             f"(__lo IS NULL OR {_after(order, lo, True)})",
                             f"(__hi IS NULL OR NOT ({_after(order, hi, True)} OR {_equal(order, hi)}))"])
        place = " + ".join(["0", *[f"CASE WHEN __at{k} IS NULL THEN 0 ELSE {_place(order, [_fields(f'__at{k}', order)], True)} END" for k in range(most)]])
        out = df.select(*[_name(c) for c in columns]).join(F.broadcast(table), F.expr(mine)).select(
            *[_name(c) for c in columns], "__range", "__rate", F.expr(place).alias("__bucket"))
    if rates and min(rates[r] for _, r in ranges) < 1.0:
        out = out.where(F.rand(seed) < F.col("__rate"))
    return out


def _rows(df: DataFrame, orders: dict[str, Order], ranges: dict[_Range, int], by: Sequence[str],
          bucket: bool = False, counted: bool = True, **what) -> list[tuple[int, tuple, int]]:
    """(range number, key tuple or bucket, rows) over all ranges in one job,
    equal keys ``counted`` together or each by itself.  Keys of different
    orders differ in type: each order has its own column."""
    frames = []
    for name, order in orders.items():
        mine = [(i, r) for r, i in ranges.items() if r.order == name]
        if mine:
            key = (F.struct("__bucket") if bucket else F.struct(*[_name(c) for c, _ in order])).alias("__key")
            one = _in_ranges(df, order, by, mine, **what).select("__range", key)
            frames.append(one.groupBy("__range", "__key").agg(F.count(F.lit(1)).alias("__n")) if counted else one.withColumn("__n", F.lit(1)))
    whole = None
    for i, f in enumerate(frames):
        one = f.select("__range", "__n", *[
            (F.col("__key") if i == k else F.lit(None).cast(g.schema["__key"].dataType)).alias(f"__key{k}") for k, g in enumerate(frames)])
        whole = one if whole is None else whole.unionByName(one)
    return [(r[0], tuple(next(x for x in r[2:] if x is not None)), r[1]) for r in whole.collect()]


def _splitters(df, orders, todo, by, seed):
    """One round: for each range its splitters and the counts of its buckets."""
    ranges = {r: i for i, r in enumerate(dict.fromkeys(todo.values()))}
    share = max(float(LEAST_SAMPLE), ACCURACY / len(ranges))
    rates = {r: min(1.0, share / max(1, r.rows)) for r in ranges}
    sampled: dict[_Range, list[tuple]] = {r: [] for r in ranges}
    names = list(ranges)
    for i, key, n in _rows(df, orders, ranges, by, counted=False, rates=rates, seed=seed):
        sampled[names[i]] += [key] * n
    points: dict[_Range, list[tuple]] = {}
    for r, rows in sampled.items():
        key = _sort_key(orders[r.order])
        rows.sort(key=key)
        at = set()
        for p in (t[2] for t, x in todo.items() if x == r):
            share, m, rate = (p - r.before + 0.5) / r.rows, len(rows), rates[r]
            off = STAND_OFF * math.sqrt(m * share * (1 - share) * (1 - rate)) + (rate < 1.0)
            at |= {min(m - 1, max(0, math.floor(share * m - off))), min(m - 1, max(0, math.floor(share * m + off)))} if m else set()
        chosen: list[tuple] = []
        for a in sorted(at):
            if not chosen or key(chosen[-1]) < key(rows[a]):
                chosen.append(rows[a])
        points[r] = chosen
    counts: dict[_Range, dict[int, int]] = {r: {} for r in ranges}
    for i, (bucket,), n in _rows(df, orders, ranges, by, bucket=True, points=points):
        counts[names[i]][bucket] = n
    return {r: (points[r], counts[r]) for r in ranges}


def _bucket(position: int, r: _Range, points: list[tuple], counts: dict[int, int]):
    """Where a position falls: (tuple, rows before, rows equal) or a narrower range."""
    before = r.before
    for b in range(2 * len(points) + 1):
        n = counts.get(b, 0)
        if position < before + n:
            k = b // 2
            if b % 2:
                return points[k], before, n
            return _Range(r.order, r.group, points[k - 1] if k else r.lo, points[k] if k < len(points) else r.hi, before, n)
        before += n
    raise ValueError(f"position {position} lies beyond the {before} rows of group {r.group}")


def _fetch(df, orders, todo, by):
    """Few rows of each range, counted off to the position."""
    ranges = {r: i for i, r in enumerate(dict.fromkeys(todo.values()))}
    rows: dict[int, list[tuple]] = {i: [] for i in ranges.values()}
    for i, key, n in _rows(df, orders, ranges, by):
        rows[i].append((key, n))
    out = {}
    for r, i in ranges.items():
        key = _sort_key(orders[r.order])
        rows[i].sort(key=lambda x: key(x[0]))
    for t, r in todo.items():
        at = r.before
        for tup, n in rows[ranges[r]]:
            if at <= t[2] < at + n:
                out[t] = (tup, at, n)
                break
            at += n
    return out


def boundaries(df: DataFrame, order: Order, wanted: dict[tuple, Iterable[int]],
               sizes: dict[tuple, int], by: Sequence[str] = ()) -> dict[tuple, tuple]:
    """The key tuple of the row at each (group, position)."""
    return {(g, p): x[0] for (_, g, p), x in find(df, {"order": order}, {"order": wanted}, sizes, by).items()}


def locate(df: DataFrame, value: str, wanted: dict[tuple, Iterable[int]], sizes: dict[tuple, int],
           by: Sequence[str] = ()) -> dict[tuple, tuple]:
    """For each group and position of ``value`` ascending: (value there, rows
    below that value, rows of that value)."""
    found = find(df, {"value": [(value, True)]}, {"value": wanted}, sizes, by)
    return {(g, p): (x[0], below, same) for (_, g, p), (x, below, same) in found.items()}
