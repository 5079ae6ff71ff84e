"""Stored transaction tables: replaced safely, counted while written, laid out
by customer, and summarised by mergeable sketches (A2-A4, B2, B12).

``replace_table`` writes each version of a table into a folder of its own and
then names it in a small pointer file, which the file system swaps in one
step: readers see the old version or the new one, and a write that fails
leaves the old one as it was.  The row count and the row-level checks come from
the writing job itself.

``write_by_customer`` stores a table bucketed and sorted by customer: every
per-customer aggregation over it runs without moving a row."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from custlytics.functions.dates import day, month_key, month_label
from custlytics.schemas import TX, TxCols

POINTER = "_current"
#: Versions before the current one that stay for readers at work.
KEPT_VERSIONS = 1
#: log2 of an HLL sketch's registers: standard error 1.04 / sqrt(2^LG) of a distinct count.
SKETCH_LG = 12


@dataclass(frozen=True)
class Landed:
    """What the writing job saw: rows, nulls by column, rows whose value or
    quantity is not positive, first and last date (text)."""
    path: str
    rows: int
    nulls: dict[str, int]
    non_positive: dict[str, int]
    first: str | None
    last: str | None


def _observed(df: DataFrame, cols: TxCols) -> tuple[DataFrame, Observation]:
    """``df`` with the row-level checks counted as it passes by."""
    seen = Observation()
    exprs = [F.count(F.lit(1)).alias("rows")]
    exprs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null:{c}") for c in df.columns]
    exprs += [F.count_if(F.col(f"`{c}`") <= 0).alias(f"low:{c}") for c in (cols.value, cols.quantity) if c in df.columns]
    if cols.date in df.columns:
        exprs += [F.min(day(cols.date)).cast("string").alias("first"), F.max(day(cols.date)).cast("string").alias("last")]
    return df.observe(seen, *exprs), seen


def _landed(path: str, seen: Observation) -> Landed:
    got = seen.get
    return Landed(path, got["rows"], {k[5:]: v for k, v in got.items() if k.startswith("null:")},
                  {k[4:]: v for k, v in got.items() if k.startswith("low:")}, got.get("first"), got.get("last"))


class _Files:
    """The few file operations that a pointer needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, target: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.target = target.rstrip("/")
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.target, *names]))

    def read(self) -> str | None:
        if not self.fs.exists(self.path(POINTER)):
            return None
        stream = self.fs.open(self.path(POINTER))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).strip()
        finally:
            stream.close()

    def swap(self, version: str) -> None:
        """Name ``version`` in the pointer, in one step."""
        fresh = self.path(f"{POINTER}-{uuid.uuid4().hex[:8]}")
        stream = self.fs.create(fresh, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        context.rename(self.fs.makeQualified(fresh), self.fs.makeQualified(self.path(POINTER)), options)

    def versions(self) -> list[str]:
        """Version folders, oldest first."""
        found = [(s.getModificationTime(), s.getPath().getName()) for s in self.fs.listStatus(self.path()) if s.getPath().getName().startswith("v-")]
        return [name for _, name in sorted(found)]

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def replace_table(df: DataFrame, target: str, cols: TxCols = TX, by_month: bool = True,
                  max_records_per_file: int | None = None) -> Landed:
    """A2: replace the table at ``target`` by ``df`` as one step, and tell what
    was written.  Each task sorts its rows by month, so it writes one month
    folder at a time; ``df`` may read the table that it replaces."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex[:12]}"
    files = _Files(spark, target)
    out, seen = _observed(df, cols)
    if by_month:
        out = out.withColumn("order_month", month_label(month_key(cols.date))).sortWithinPartitions("order_month")
    w = out.write.mode("error")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if by_month:
        w = w.partitionBy("order_month")
    try:
        w.parquet(f"{files.target}/{version}")
    except Exception:
        files.drop(version)                                  # what was written of it; the pointer never named it
        raise
    before = files.read()
    files.swap(version)
    old = [v for v in files.versions() if v not in (version, before)]
    for name in old[:len(old) - (KEPT_VERSIONS - 1)]:
        files.drop(name)
    return _landed(f"{files.target}/{version}", seen)


def current_version(spark: SparkSession, target: str) -> str:
    """The folder of the table's current version."""
    name = _Files(spark, target).read()
    if name is None:
        raise FileNotFoundError(f"{target} holds no table")
    return f"{target.rstrip('/')}/{name}"


def load_table(spark: SparkSession, target: str, schema=None) -> DataFrame:
    """A3: the current version of a replaceable table.  A table without rows
    holds no file to read a schema from: pass it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(current_version(spark, target))


def write_by_customer(df: DataFrame, name: str, buckets: int, path: str | None = None, spread: int = 4, cols: TxCols = TX) -> DataFrame:
    """A2: ``df`` as catalogue table ``name``, bucketed and sorted by customer.

    A bucket is written by ``spread`` tasks, dealt by a hash of the id, so a
    customer with a third of all rows is no single task's work; the aggregates
    read a bucket's files together."""
    slot = F.pmod(F.xxhash64(F.col(cols.id)), F.lit(spread))
    # the tasks of a bucket: the bucket's own hash, as the writer deals rows, and a slot
    bucket = F.pmod(F.hash(F.col(cols.customer)), F.lit(buckets))
    w = df.repartition(buckets * spread, bucket, slot).write.mode("overwrite").format("parquet").bucketBy(buckets, cols.customer).sortBy(cols.customer)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)
    return df.sparkSession.table(name)


# ------------------------------------------------------------------- sketches

def customer_sketches(tx: DataFrame, by: tuple[str, ...] = (), cols: TxCols = TX) -> DataFrame:
    """A mergeable sketch of the distinct customers of each month (and
    of each value of ``by``), with its rows: order_month, by..., rows, sketch.
    Sketches have a fixed size, so partial results combine before the shuffle."""
    month = month_label(month_key(cols.date)).alias("order_month")
    return tx.groupBy(month, *[F.col(c) for c in by]).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(F.col(cols.customer), SKETCH_LG).alias("sketch"))


def customers_between(sketches: DataFrame, first: str | None = None, last: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Estimated distinct customers and rows of months ``first`` to ``last``
    (both included; open if None) from the sketches alone: no fact row is read."""
    rows = sketches
    if first is not None:
        rows = rows.where(F.col("order_month") >= first)
    if last is not None:
        rows = rows.where(F.col("order_month") <= last)
    merged = F.hll_union_agg("sketch")
    return rows.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(merged).alias("customers"))


def sketch_error(sigmas: float = 4.0) -> float:
    """Relative error that an estimate keeps within with ``sigmas`` standard errors."""
    return sigmas * 1.04 / 2 ** (SKETCH_LG / 2)


def within_error(estimate: Column, exact: Column) -> Column:
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * sketch_error())
