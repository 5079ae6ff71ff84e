"""Shards by extendible hashing.

A directory maps hash-prefix bits to buckets.  It starts at the depth where
buckets of average size would fit; a bucket over the byte limit splits on its
next bit until it fits or holds one document; buckets that fit never split.  A
shard is a bucket, named by its prefix as a string of bits.

Documents are counted once, by a prefix longer than the directory needs
(pre-aggregated before the shuffle); the directory is built from those counts:
of the prefixes of a cell, the shortest that fits is its bucket.  Buckets that
are still too large at that depth are counted again by the bits that follow,
first of the id's hash, then of the text's; rows equal in both are numbered
and fill overflow shards (``prefix.number``) in turn.

Defined results: a null id hashes as the word ``null``; a null text has no
bytes; of equal rows any may take any place; a document over the limit by
itself is a shard of its own; an empty table gives an empty result; other
columns are carried."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custlytics.session import materialize_table

LIMIT_BYTES = 16 << 20
#: Bits of the first count, bits by which it is finer than the starting
#: depth, and bits a row has: 32 of its id, 32 of its text.
FIRST_BITS, FINER, ALL_BITS = 16, 6, 64
#: Rows up to which a directory is broadcast (about 60 bytes each).
BROADCAST_ROWS = 200_000
MADE = ["shard", "depth", "doc_bytes", "shard_bytes", "shard_docs"]


def _bits(text: Column) -> Column:
    """32 bits of an md5 as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 2), 32, "0")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _cells(rows: DataFrame, depth: int) -> DataFrame:
    return rows.groupBy(F.substring("__bits", 1, depth).alias("cell")).agg(
        F.sum("__bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_docs"))


def directory(cells: DataFrame, start: int, finest: int, limit: int) -> DataFrame:
    """cell, shard, shard_bytes, shard_docs: the shortest prefix, from depth
    ``start``, that fits; at depth ``finest`` whatever is left."""
    levels = cells.select("cell", "n_bytes", "n_docs", F.explode(F.sequence(F.lit(start), F.lit(finest))).alias("d")).select(
        "cell", "n_bytes", "n_docs", F.expr("substring(cell, 1, d)").alias("shard"))
    buckets = levels.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs"))
    fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") <= 1) | (F.length("shard") == finest))
    best = F.min(F.struct(F.length("shard").alias("n"), "shard", "shard_bytes", "shard_docs")).alias("b")
    found = levels.select("cell", "shard").join(fits, "shard").groupBy("cell").agg(best)
    return materialize_table(found.select("cell", "b.shard", "b.shard_bytes", "b.shard_docs"), "directory")


def _place(rows: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    found = found.withColumnRenamed("cell", "__cell")        # rows carry the caller's columns
    return rows.join(_small(found), F.substring("__bits", 1, depth) == F.col("__cell")).drop("__cell")


def _place_by_bucket(rows: DataFrame, found: DataFrame, start: int) -> DataFrame:
    """Rows with the bucket whose bits theirs begin with (rows of none go).
    Buckets, not cells, are sent: listed by their first ``start`` bits, one or
    two to a list on average, as start is where average buckets would fit."""
    bucket = F.struct("shard", "shard_bytes", "shard_docs")
    lists = found.select("shard", "shard_bytes", "shard_docs").distinct().groupBy(
        F.substring("shard", 1, start).alias("__cell")).agg(F.collect_list(bucket).alias("__buckets"))
    met = rows.join(_small(lists), F.substring("__bits", 1, start) == F.col("__cell")).drop("__cell")
    mine = F.filter("__buckets", lambda b: F.startswith(F.col("__bits"), b["shard"]))
    return met.withColumn("__bucket", F.explode(mine)).drop("__buckets").select("*", "__bucket.*").drop("__bucket")


def _overflow(rows: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """Equal rows numbered across partitions, as many to a shard as fit."""
    rows = rows.withColumns({"__task": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    rows = materialize_table(rows, "equal")                  # the numbers are data from here on
    inside = Window.partitionBy("__bits", "__task").orderBy("__at")
    rows = rows.withColumn("__nth", F.row_number().over(inside) - 1)
    tasks = rows.groupBy("__bits", "__task").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__bits").orderBy("__task")) - F.col("__n")
    rows = rows.join(_small(tasks.select(F.col("__bits").alias("__b"), F.col("__task").alias("__t"), before.alias("__before"))),
                     (F.col("__bits") == F.col("__b")) & (F.col("__task") == F.col("__t")))
    rows = _place(rows, found, ALL_BITS)
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("__bytes"))).cast("long")
    number = F.floor((F.col("__before") + F.col("__nth")) / fit).cast("long")
    held = F.least(fit, F.col("shard_docs") - number * fit)
    return rows.withColumns({"shard": F.concat("shard", F.lit("."), number.cast("string")),
                             "shard_docs": held, "shard_bytes": held * F.col("__bytes")})


def assign(docs: DataFrame, limit: int = LIMIT_BYTES, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows with ``shard``, ``depth`` (bits), ``doc_bytes``,
    ``shard_bytes`` and ``shard_docs``."""
    names = [c for c in docs.columns if c not in MADE]
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(*[F.col(f"`{c}`") for c in names],
                       _bits(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))).alias("__bits"),
                       F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("__bytes"))
    depth = FIRST_BITS
    cells = materialize_table(_cells(rows, depth), "cells")
    total = cells.agg(F.sum("n_bytes")).first()[0] or 0
    start = min(32, max(0, math.floor(math.log2(max(1, total / limit)))))
    if start + FINER > depth:
        depth = min(32, start + FINER)
        cells = materialize_table(_cells(rows, depth), "cells")
    found = directory(cells, start, depth, limit)
    over = (F.length("shard") == depth) & (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
    full = found.where(over).select(F.col("cell").alias("__cell"))
    placed = [_place_by_bucket(rows, found.where(~over), start)]
    if full.limit(1).count():
        more = rows.join(_small(full), F.substring("__bits", 1, depth) == F.col("__cell"), "left_semi").withColumn(
            "__bits", F.concat("__bits", _bits(F.coalesce(body, F.lit("")))))
        found = directory(_cells(more, ALL_BITS), depth, ALL_BITS, limit)
        over = (F.length("shard") == ALL_BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
        placed.append(_place(more, found.where(~over), ALL_BITS))
        full = found.where(over)
        if full.limit(1).count():
            equal = more.join(_small(full.select(F.col("cell").alias("__cell"))), F.col("__bits") == F.col("__cell"), "left_semi")
            placed.append(_overflow(equal, full, limit))
    pick = [*[F.col(f"`{c}`") for c in names], "shard", F.length(F.split_part("shard", F.lit("."), F.lit(1))).alias("depth"),
            F.col("__bytes").alias("doc_bytes"), "shard_bytes", "shard_docs"]
    out = placed[0].select(*pick)
    for p in placed[1:]:
        out = out.unionByName(p.select(*pick))
    return out


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, **options) -> None:
    """Write each shard as one Parquet file in a folder of its name: a task
    holds shards whole, and a shard holds ``limit`` bytes of text at most."""
    placed = assign(docs, limit, **options).withColumn("shard", F.concat(F.lit("s"), "shard"))
    placed.repartition("shard").sortWithinPartitions("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def duckdb_sql(table: str = "documents", limit: int = LIMIT_BYTES) -> str:
    """doc_id, shard, depth, doc_bytes, shard_bytes, shard_docs in DuckDB SQL
    (ids all different)."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS doc_bytes,
                  lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT), 32, '0') AS bits FROM {table}),
s AS (SELECT least(32, greatest(0, floor(log2(greatest(1.0, sum(doc_bytes)::DOUBLE / {limit})))))::INTEGER AS start FROM d),
l AS (SELECT d.*, substr(bits, 1, n) AS shard FROM d, s, range(0, 33) AS r(n) WHERE n >= start),
b AS (SELECT shard, sum(doc_bytes) AS shard_bytes, count(*) AS shard_docs FROM l GROUP BY shard),
f AS (SELECT * FROM b WHERE shard_bytes <= {limit} OR shard_docs <= 1)
SELECT doc_id, shard, length(shard)::INTEGER AS depth, doc_bytes, shard_bytes::BIGINT AS shard_bytes, shard_docs
FROM l JOIN f USING (shard) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(shard)) = 1"""
