"""Global rank, global running sums and exact quantiles without a one-task
window.

A window with no partition spec moves every row into one task.  Instead the
rows are sorted by Spark itself (``orderBy``: a sampled range partitioning,
then a sort inside each partition), and each row records its position with
``monotonically_increasing_id`` (partition index in the high bits, position
inside the partition in the low bits).  The sorted rows are written once as
a Parquet table in the shared checkpoint folder, which fixes the positions:
a lost executor later only re-reads files.  The offset of a partition is the
number of rows (or the measure total) of all earlier partitions -- a table
with one row per partition, broadcast to the join.

Because the sort key is total (it ends in a unique tie-break), the range
partitioner splits even a leading value shared by a third of the rows over
many partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlytics.operators.select import locate
from custlytics.session import materialize_table

POSITION_BITS = 33          # monotonically_increasing_id: record number bits
#: Groups of which quantiles are located on the driver.
MOST_GROUPS = 1_000

OrderSpec = Sequence["str | tuple[str, bool] | tuple[str, str]"]


def _norm_order(order: OrderSpec) -> list[tuple[str, bool]]:
    out = []
    for o in order:
        if isinstance(o, str):
            out.append((o, True))
        else:
            c, d = o
            asc = d if isinstance(d, bool) else str(d).lower().startswith("asc")
            out.append((c, asc))
    return out


def sort_columns(order: OrderSpec) -> list[Column]:
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in _norm_order(order)]


def sorted_positions(df: DataFrame, order: OrderSpec, partitions: int | None = None) -> DataFrame:
    """``df`` sorted by ``order`` and materialised with ``__pid`` (sorted
    partition index) and ``__pos`` (0-based position inside it).

    ``partitions`` fixes the number of ranges; by default Spark/AQE size
    them from ``spark.sql.shuffle.partitions`` and the advisory size."""
    cols = sort_columns(order)
    s = (df.repartitionByRange(partitions, *cols).sortWithinPartitions(*cols)
         if partitions else df.orderBy(*cols))
    s = materialize_table(s.withColumn("__mid", F.monotonically_increasing_id()))
    return (s.withColumn("__pid", F.shiftright(F.col("__mid"), POSITION_BITS))
            .withColumn("__pos", F.col("__mid").bitwiseAND((1 << POSITION_BITS) - 1))
            .drop("__mid"))


def _offsets(s: DataFrame, measures: Mapping[str, Column], dtype: str) -> DataFrame:
    """Exclusive prefix totals per sorted partition (one row per partition:
    a proven bound, collected and broadcast)."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.sum(m).alias(k) for k, m in measures.items()]
    totals = sorted(s.groupBy("__pid").agg(*aggs).collect(), key=lambda r: r["__pid"])
    run = {k: 0 for k in ["_rows", *measures]}
    rows = []
    for r in totals:
        rows.append((r["__pid"], *[run[k] for k in run]))
        for k in run:
            run[k] += r[k] or 0
    tname = {"bigint": "bigint", "double": "double"}.get(dtype, dtype)
    schema = "__pid bigint, __off_rows bigint" + "".join(f", __off_{k} {tname}" for k in measures)
    return F.broadcast(s.sparkSession.createDataFrame(rows, schema))


def global_rank(df: DataFrame, order: OrderSpec, name: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """1-based row number over the whole frame in ``order``, which must be
    total (end with a unique column) for the result to be deterministic.
    The whole frame is sorted and written once: keep it narrow, and use
    :mod:`custlytics.operators.select` where a few positions are enough."""
    s = sorted_positions(df, order, partitions)
    off = _offsets(s, {}, "bigint")
    return (s.join(off, "__pid").withColumn(name, (F.col("__off_rows") + F.col("__pos") + 1).cast("bigint"))
            .drop("__pid", "__pos", "__off_rows"))


def global_running_sum(df: DataFrame, order: OrderSpec, measures: Mapping[str, Column],
                       dtype: str = "bigint", inclusive: bool = True,
                       partitions: int | None = None) -> DataFrame:
    """Add global running sums of each measure in ``order`` (``inclusive``
    of the current row or not)."""
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    s = sorted_positions(df, order, partitions)
    off = _offsets(s, measures, dtype)
    w = Window.partitionBy("__pid").orderBy("__pos").rowsBetween(*frame)
    cols = [(F.coalesce(F.sum(m).over(w), F.lit(0).cast(dtype)) + F.col(f"__off_{k}")).cast(dtype).alias(k)
            for k, m in measures.items()]
    out = s.join(off, "__pid").select("*", *cols)
    return out.drop("__pid", "__pos", "__off_rows", *[f"__off_{k}" for k in measures])


# ---------------------------------------------------------------- quantiles

def rank_quantile_edges(n: int, probs: Iterable[float] = (0.25, 0.5, 0.75)) -> list[float]:
    """Linear-interpolated quantiles of the ranks 1..n."""
    return [1 + (n - 1) * p for p in probs]


def score_by_edges(value: Column, edges: Sequence[float], labels: Sequence[int]) -> Column:
    """Label of the right-closed bin holding ``value``: labels[i] for values in
    (edges[i-1], edges[i]] with the last label past the last edge; null for null."""
    above = sum(((value > F.lit(e)).cast("int") for e in edges), F.lit(0))
    arr = F.array(*[F.lit(int(x)) for x in labels])
    return F.when(value.isNotNull(), F.element_at(arr, above + 1))


def check_unique_edges(edges: Sequence[float], duplicates: str = "raise") -> list[float]:
    if duplicates not in ("raise", "drop"):
        raise ValueError("duplicates must be 'raise' or 'drop'")
    uniq = sorted(set(edges))
    if len(uniq) != len(edges):
        if duplicates == "raise":
            raise ValueError(f"Bin edges must be unique: {list(edges)}. "
                             "Pass duplicates='drop' to merge the empty bins.")
    return uniq


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles per group (``by``, null included)
    of ``value``, as columns ``q0, q1, ...``.

    The two values around each quantile are found by counting
    (:mod:`custlytics.operators.select`): no sort, no shuffle of rows, and a
    hot group costs no more than any other.  That takes a few collected rows a
    group; beyond ``MOST_GROUPS`` groups each is aggregated by Spark's own
    ``percentile``, which counts a group's distinct values."""
    by = list(by)
    base = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    counted = base.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).limit(MOST_GROUPS + 1).collect()
    if len(counted) > MOST_GROUPS:
        return base.groupBy(*by).agg(*[F.percentile("__v", float(p)).alias(f"q{i}") for i, p in enumerate(probs)])
    sizes = {tuple(r[c] for c in by): r["__n"] for r in counted if r["__n"]}
    wanted = {g: sorted({at for p in probs for at in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}) for g, n in sizes.items()}
    found = locate(base, "__v", wanted, sizes, by)
    rows = []
    for g, n in sizes.items():
        qs = []
        for p in probs:
            h = (n - 1) * p
            lo, hi = math.floor(h), math.ceil(h)
            a, b = found[g, lo][0], found[g, hi][0]
            # (hi - h) * v_lo + (h - lo) * v_hi, the interpolation of Spark's percentile
            qs.append(a if lo == hi else (hi - h) * a + (h - lo) * b)
        rows.append((*g, *qs))
    fields = [T.StructField(c, df.schema[c].dataType) for c in by] + [T.StructField(f"q{i}", T.DoubleType()) for i in range(len(probs))]
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))
