"""Transaction sources and result sinks.

CSV is read with an explicit schema (no inference pass over the data),
dates are parsed with ``try_to_timestamp`` so unparsable values become nulls
that the quality suite counts, and the table is stored as Parquet
partitioned by order month so date filters prune whole folders."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlytics.functions.dates import month_key, month_label
from custlytics.schemas import TRANSACTIONS
from custlytics.session import materialize_table

CORRUPT = "_corrupt_record"


def parse_transactions(raw: DataFrame, date_format: str | None = None) -> DataFrame:
    """Type the text date columns (bad values -> null)."""
    fmt = F.lit(date_format) if date_format else None
    ts = F.try_to_timestamp(F.col("transaction_date"), fmt) if fmt is not None else \
        F.try_to_timestamp(F.col("transaction_date"))
    out = raw.withColumn("transaction_date", ts.cast("timestamp_ntz"))
    if "signup_date" in raw.columns:
        out = out.withColumn("signup_date", F.try_to_timestamp(F.col("signup_date")).cast("date"))
    return out


BAD_ROW_MODES = {"null": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv",
                      schema: T.StructType = TRANSACTIONS, bad_rows: str = "null",
                      keep_corrupt: bool = False) -> DataFrame:
    """A1: raw transactions from CSV (header, explicit schema) or Parquet.

    ``bad_rows``: ``"null"`` keeps a malformed line with nulls in the fields
    that do not parse (its text in ``_corrupt_record`` when
    ``keep_corrupt``), ``"drop"`` skips it, ``"fail"`` stops the job.
    Unparsable dates become null in every mode and are counted by the
    quality suite."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if bad_rows not in BAD_ROW_MODES:
        raise ValueError(f"bad_rows must be one of {sorted(BAD_ROW_MODES)}")
    keep = keep_corrupt and bad_rows == "null"
    s = T.StructType(list(schema.fields) + ([T.StructField(CORRUPT, T.StringType())] if keep else []))
    r = spark.read.schema(s).option("header", True).option("mode", BAD_ROW_MODES[bad_rows])
    if keep:
        r = r.option("columnNameOfCorruptRecord", CORRUPT)
    return parse_transactions(r.csv(path))


def write_transactions(df: DataFrame, target: str, mode: str = "overwrite",
                       partition_by_month: bool = True, date_col: str = "transaction_date",
                       max_records_per_file: int | None = None) -> int:
    """A2: store as Parquet (partitioned by ``order_month``) and report the
    row count, read back from the written table.

    Each task sorts its rows by month before writing, so it writes one month
    folder at a time instead of keeping a file open per month; the data is
    not repartitioned by month (a month holding a third of the rows would
    become one task).  ``max_records_per_file`` caps file sizes."""
    out = df
    if partition_by_month:
        out = df.withColumn("order_month", month_label(month_key(date_col))).sortWithinPartitions("order_month")
    w = out.write.mode(mode)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partition_by_month:
        w = w.partitionBy("order_month")
    w.parquet(target)
    return df.sparkSession.read.schema(out.schema).parquet(target).count()


def load_transactions(spark: SparkSession, target: str, schema: T.StructType | None = None) -> DataFrame:
    """A3: the stored table with the date typed.  A partitioned table that
    was written without rows holds no file to read a schema from: pass the
    written one's."""
    df = spark.read.parquet(target) if schema is None else spark.read.schema(schema).parquet(target)
    if dict(df.dtypes).get("transaction_date") == "string":
        df = parse_transactions(df)
    return df


@dataclass
class Profile:
    preview: DataFrame
    columns: list[str]
    rows: int

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, len(self.columns)


def profile(df: DataFrame, n: int = 5) -> Profile:
    """A4: preview rows (lazy), column list and shape."""
    return Profile(df.limit(n), df.columns, df.count())


def profile_frame(df: DataFrame) -> DataFrame:
    """A4 as a one-row DataFrame: row and column counts."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """A5: write a named result (Parquet by default, CSV with header)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def read_result(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                fmt: str = "parquet") -> DataFrame:
    """Reload a result; CSV needs its schema (dates come back typed)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", True).csv(path)
    return r.format(fmt).load(path)


def export_view(df: DataFrame, path: str) -> str:
    """The filtered customer view as CSV with header."""
    return write_result(df, path, fmt="csv")


def run_reports(spark: SparkSession, tx: DataFrame, out_dir: str,
                names: list[str] | None = None, fmt: str = "parquet",
                builders: Mapping[str, object] | None = None, land: bool = True) -> dict[str, str]:
    """Build and write a batch of named reports, one write per report.

    The table is landed once as Parquet in the scratch folder, so a text
    source is parsed once and every report reads only the columns it needs;
    pass ``land=False`` for a table that is columnar already."""
    from custlytics.operators import cohort, customer, rfm
    if land:
        tx = materialize_table(tx, "landed")
    jobs = dict(builders or {
        "rfm_output": lambda t: rfm.rfm(t),
        "cohort_output": lambda t: cohort.cohort_retention(t),
        "churn_output": lambda t: customer.customer_churn(t),
    })
    out = {}
    for name in names or list(jobs):
        path = f"{out_dir.rstrip('/')}/{name}"
        out[name] = write_result(jobs[name](tx), path, fmt)
    return out
