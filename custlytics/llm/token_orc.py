"""Token ids of a corpus as ORC files.

Documents are range-partitioned and sorted by ``doc_id``, encoded in place and
written as ORC: ids in integer run-length encoding, a row index every
``ROW_INDEX_STRIDE`` rows and a Bloom filter on ``doc_id``.  One task writes
one file of stripes, so files and stripes hold disjoint ascending id ranges:
a read splits by stripe, and a lookup of an id skips files and stripes by
their minimum, maximum and Bloom filter.

Columns written: ``doc_id``, ``part`` (position of the file in the order),
``pos`` (position in the part), ``n_tokens``, ``ids``.  Offsets of documents in the whole
token sequence come from the files: token counts by part, a running sum over
the parts (one row a part) and a running sum inside each part.

Defined results: null and empty texts hold the end id alone; null ids come
first; repeated ids are ordered by a hash of the text, equal rows in any order
(their contents are the same); other columns are not stored."""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlytics.llm.tables import parallelism
from custlytics.llm.word_cache import WordCache, list_array, slices, to_bytes

STRIPE_BYTES, ROW_INDEX_STRIDE, BLOOM_FPP = 16 << 20, 1000, 0.01
END_ID = 1
#: Words encoded in one call of the library.
JOINED_WORDS = 256

STORED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()),
    T.StructField("pos", T.LongType()), T.StructField("n_tokens", T.IntegerType()),
    T.StructField("ids", T.ArrayType(T.IntegerType()))])


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, space-separated piece by
    piece with a bounded cache.

    The tokenizer drops white space and never joins across it, and neither
    Unicode composition nor its split pattern looks past an ASCII space or
    line end, so a text's ids are those of its pieces in order.  The
    constructor refuses a file whose parts differ from that.  New pieces are
    encoded together, joined by spaces again, and told apart by offsets."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"] or any(
                " " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("not a tokenizer that works piece by piece")
        self.tok = Tokenizer.from_file(path)
        self.cache = WordCache(self.encode_words)

    def encode_words(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), JOINED_WORDS):
            some = words[at:at + JOINED_WORDS]
            found = self.tok.encode(" ".join(some), add_special_tokens=False)
            raw = to_bytes(found.ids)
            ends = np.cumsum([len(w) + 1 for w in some])     # a token of a word starts before its end
            cuts = (4 * np.searchsorted([a for a, _ in found.offsets], ends)).tolist()
            out += [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def encode(self, texts: list[str | None], tail: bytes = b"") -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        return self.cache.documents([t.replace("\n", " ").split(" ") if t else [] for t in texts], tail)


@functools.lru_cache(maxsize=2)
def load_tokenizer(path: str) -> WordTokenizer:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark runs the tasks
    return WordTokenizer(path)


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers
        return public_tokenizers.path("word_bpe_49k.json")
    return path


def _below(bounds: list[int], operator: str) -> str:
    """SQL: how many of the ascending ``bounds`` are below ``key``; the groups
    of bounds first, then the bounds of one group."""
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[at:at + step] for at in range(0, len(bounds), step)]

    def listed(xs):
        return f"cast(array({', '.join(f"cast('{x}' AS bigint)" for x in xs)}) AS array<bigint>)"

    passed = f"size(filter({listed([g[-1] for g in groups])}, b -> b {operator} key))"
    inside = f"element_at(array({', '.join(listed(g) for g in [*groups, []])}), {passed} + 1)"
    return f"(least({passed} * {step}, {len(bounds)}) + size(filter({inside}, b -> b {operator} key)))"


def ranges(rows: DataFrame, n: int) -> Column:
    """The number of the range, of ``n``, in which a row of (key, text) lies.
    The bounds are approximate quantiles from a scan of the keys alone.  Rows
    of a key that takes up several ranges are dealt to these by the hash that
    orders them."""
    if n < 2:
        return F.lit(0)
    shares = ", ".join(f"{i / n}D" for i in range(1, n))
    bounds = sorted(rows.select("key").agg(F.expr(f"percentile_approx(key, array({shares}), {max(10_000, 20 * n)})")).first()[0] or [])
    if not bounds:
        return F.lit(0)
    plain, slots = F.expr(_below(bounds, "<")), F.expr(f"{_below(bounds, '<=')} - {_below(bounds, '<')}")
    hot = [x for x, m in Counter(bounds).items() if m > 1]
    share = F.xxhash64("text").cast("double") / 2.0 ** 64 + 0.5
    slot = F.least(F.floor(share * slots).cast("int"), slots - 1)
    return F.when(F.col("key").isin(hot), plain + slot).otherwise(plain) if hot else plain


def encode_sorted(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                  tokenizer_path: str | None = None, partitions: int | None = None) -> DataFrame:
    """The stored columns, range-partitioned and sorted by id."""
    n = partitions or parallelism(df.sparkSession)
    given = F.col(f"`{doc_id}`").cast("long")
    rows = df.select(given.alias("doc_id"), F.coalesce(given, F.lit(-1 << 63)).alias("key"), F.col(f"`{text}`").alias("text"))   # null ids first
    rows = rows.repartitionById(n, ranges(rows, n)).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = rows.select("doc_id", F.spark_partition_id().alias("part"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, pos, end = load_tokenizer(_path(tokenizer_path)), 0, to_bytes([END_ID])
        for batch in batches:
            for part in slices(batch, 2):
                ids = tok.encode(part.column(2).to_pylist(), end)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(range(pos, pos + len(ids)), pa.int64()),
                     pa.array([len(i) // 4 for i in ids], pa.int32()), list_array(ids)],
                    names=STORED.fieldNames())
                pos += len(ids)

    return rows.mapInArrow(run, STORED)


def write_tokens(df: DataFrame, path: str, **options) -> None:
    """Encode ``df`` and write the ORC files of ``path``."""
    (encode_sorted(df, **options).write.mode("overwrite").format("orc")
     .option("orc.compress", "ZSTD").option("orc.stripe.size", STRIPE_BYTES)
     .option("orc.row.index.stride", ROW_INDEX_STRIDE)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP)
     .save(path))


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The stored documents; ``ids`` restricts to some, pruned by file metadata."""
    df = spark.read.schema(STORED).format("orc").load(path)
    return df if ids is None else df.where(F.col("doc_id").isin(ids))


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files."""
    schema = T.StructType([*STORED.fields[:3], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.r_[0, ends[:-1]].astype(np.int64)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(ends - starts, pa.int64()), pa.array(sums, pa.int64())], names=schema.fieldNames())

    docs = read_tokens(spark, path).mapInArrow(checksum, schema)
    # one row a part: a task of the write, so at most the partitions asked for
    parts = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").cast("long").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return docs.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("before") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32")
