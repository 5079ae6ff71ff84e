"""Mixing sources to target weights by temperature.

A source's share of the corpus tokens, raised to an exponent and normalised,
is its weight: exponent 1 keeps the shares, 0 makes the sources equal.  The
exponent is bisected (many points a round, one aggregation over the sources)
to the smallest that keeps every source within ``max_repeats`` showings of its
documents, or to the largest whose weights reach ``target_entropy``.

Weights become token quotas under a budget; by default the smallest budget
that shows every document at least once.  A quota is whole epochs of a source
and a part of one more.  Documents fall into hashed blocks; an epoch is a
permutation of the source's blocks, and the last one takes blocks in that
order until the quota is used up, cutting the block at the boundary by its
documents in hashed order.  Only block totals are ordered, so a source that
holds a third of the corpus is as many narrow rows as any other.

Defined results: tokens are runs of characters other than ASCII white space;
documents without tokens (null, empty or blank text) and those of sources
without tokens are shown once; a null source counts as the source named by the
empty string; rows that share an id and a source move together; an empty table
gives an empty result; other columns are carried."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custlytics.session import materialize_table

#: Points of the exponent tried in one round, and rounds: 32 ** -5 is 3e-8.
GRID, ROUNDS = 32, 5
MAX_REPEATS, BLOCKS, SEED = 2.0, 1024, 7
#: Rows up to which the block table is broadcast (about 40 bytes each).
BROADCAST_BLOCKS = 200_000
WORD = "[^\\x20\\x09-\\x0D]+"
SLACK = 1e-9


@dataclass(frozen=True)
class Target:
    """One of the two aims of the exponent; ``budget`` in tokens, or None for
    the smallest that shows every document."""
    max_repeats: float | None = MAX_REPEATS
    target_entropy: float | None = None
    budget: int | None = None

    def __post_init__(self):
        if (self.max_repeats is None) == (self.target_entropy is None):
            raise ValueError("give either max_repeats or target_entropy")


def _hash(*parts: Column | str) -> Column:
    """Sixteen hexadecimal digits of an order that any engine can compute."""
    return F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def _slim(docs: DataFrame, doc_id: str, text: str, source: str, blocks: int, seed: int) -> list[Column]:
    src = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))
    return [src.alias("__src"), key.alias("__key"),
            F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("__tokens"),
            (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), src, key).cast("binary")), 1, 8), 16, 10)
             .cast("long") % blocks).cast("int").alias("__block")]


def _aggregates(shares: DataFrame, points: list[float]) -> dict[float, tuple[float, float, float, float]]:
    """For each exponent: sum of p^a, sum of p^a ln p, largest and smallest p^(a-1)."""
    grid = shares.select("p", F.explode(F.array(*[F.lit(x) for x in points])).alias("a"))
    power = F.pow("p", "a")
    rows = grid.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("l"),
                                 F.max(power / F.col("p")).alias("hi"), F.min(power / F.col("p")).alias("lo")).collect()
    return {r["a"]: (r["z"], r["l"], r["hi"], r["lo"]) for r in rows}


def _enough(a: float, sums: tuple, target: Target, total: int) -> bool:
    """Whether the exponent is large enough: repeats fit, or any larger one
    would fall under the entropy."""
    z, l, hi, lo = sums
    if target.max_repeats is not None:
        return (hi / lo if target.budget is None else target.budget / total * hi / z) <= target.max_repeats + SLACK
    import math
    return math.log(z) - a * l / z <= target.target_entropy + SLACK


def exponent(shares: DataFrame, target: Target, total: int) -> float:
    """The smallest grid point that is large enough (1 if none is)."""
    lo, width = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [lo + width * k / GRID for k in range(GRID + 1)]
        sums = _aggregates(shares, points)
        at = next((k for k, a in enumerate(points) if _enough(a, sums[a], target, total)), GRID)
        if at == 0:
            return points[0]
        lo, width = points[at - 1], width / GRID
    return lo + width


def plan(docs: DataFrame, target: Target, *, doc_id: str, text: str, source: str, blocks: int, seed: int) -> DataFrame | None:
    """(__src, __block, epoch, block_rank, whole, room): the blocks each epoch
    takes; ``room`` is the tokens left for a block that is cut."""
    totals = materialize_table(docs.select(*_slim(docs, doc_id, text, source, blocks, seed)).groupBy("__src", "__block").agg(
        F.sum("__tokens").alias("tokens")).where("tokens > 0"), "blocks")
    by_source = totals.groupBy("__src").agg(F.sum("tokens").alias("t"))
    by_source = materialize_table(by_source, "sources")
    total = by_source.agg(F.sum("t")).first()[0]
    if not total:
        return None
    shares = by_source.withColumn("p", F.col("t") / F.lit(float(total)))
    a = exponent(shares, target, total)
    z, _, _, lo = _aggregates(shares, [a])[a]
    scale = 1.0 / lo if target.budget is None else target.budget / total / z
    ratio = F.round(F.pow("p", F.lit(a)) / F.col("p") * F.lit(scale), 6)
    quotas = shares.select("__src", "t", ratio.alias("repeats"), F.floor(F.col("t") * ratio).cast("long").alias("quota"))
    quotas = quotas.select("__src", "repeats", F.floor(F.col("quota") / F.col("t")).cast("int").alias("epochs"),
                           (F.col("quota") - F.floor(F.col("quota") / F.col("t")) * F.col("t")).alias("rest"))
    rows = totals.join(quotas, "__src").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    order = Window.partitionBy("__src", "epoch").orderBy(
        _hash(F.lit(str(seed)), F.col("epoch").cast("string"), "__src", F.col("__block").cast("string")), "__block")
    rows = rows.withColumns({"block_rank": F.row_number().over(order),
                             "before": F.sum("tokens").over(order) - F.col("tokens")})
    whole = (F.col("epoch") < F.col("epochs")) | (F.col("before") + F.col("tokens") <= F.col("rest"))
    rows = rows.withColumns({"whole": whole, "room": F.col("rest") - F.col("before")})
    return materialize_table(rows.where("whole OR room > 0").select(
        "__src", "__block", "epoch", "block_rank", "whole", "room"), "taken")


def mix(docs: DataFrame, target: Target = Target(), *, doc_id: str = "doc_id", text: str = "text",
        source: str = "source", blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The input's rows, each as often as its source's quota shows it, with
    ``n_tokens`` (bigint), ``epoch``, ``block``, ``block_rank`` (int; the last
    null for rows without tokens).  (epoch, block_rank) orders a source."""
    made = ["n_tokens", "epoch", "block", "block_rank"]
    names = [c for c in docs.columns if c not in made]
    options = dict(doc_id=doc_id, text=text, source=source, blocks=blocks, seed=seed)
    taken = plan(docs, target, **options)
    rows = docs.select(*[F.col(f"`{c}`") for c in names], *_slim(docs, **options))
    none = rows.where("__tokens = 0").select(
        *[F.col(f"`{c}`") for c in names], F.col("__tokens").alias("n_tokens"), F.lit(0).alias("epoch"),
        F.col("__block").alias("block"), F.lit(None).cast("int").alias("block_rank"))
    if taken is None:
        return none

    # documents of the blocks that are cut: one block a source
    cut = taken.where("NOT whole").withColumnRenamed("room", "left")
    inside = docs.select(*_slim(docs, **options)).where("__tokens > 0").join(_small(cut), ["__src", "__block"])
    inside = inside.groupBy("__src", "__block", "epoch", "left", "__key").agg(F.sum("__tokens").alias("tokens"))
    order = Window.partitionBy("__src", "__block").orderBy(
        _hash(F.lit(str(seed)), F.col("epoch").cast("string"), "__src", "__key"), "__key")
    inside = inside.withColumn("upto", F.sum("tokens").over(order)).where(F.col("upto") <= F.col("left"))
    inside = materialize_table(inside.select("__src", "__key", "__block"), "cut")

    out = rows.where("__tokens > 0").join(_small(taken.where("whole").drop("whole", "room")), ["__src", "__block"])
    part = rows.where("__tokens > 0").join(_small(inside), ["__src", "__key", "__block"], "left_semi").join(
        _small(cut.drop("whole", "left")), ["__src", "__block"])
    pick = [*[F.col(f"`{c}`") for c in names], F.col("__tokens").alias("n_tokens"), "epoch",
            F.col("__block").alias("block"), "block_rank"]
    return out.select(*pick).unionByName(part.select(*pick)).unionByName(none)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of blocks while it is small, else let it shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_BLOCKS else df


def duckdb_sql(table: str = "documents", max_repeats: float = MAX_REPEATS, blocks: int = BLOCKS, seed: int = SEED) -> str:
    """doc_id, source, n_tokens, epoch, block, block_rank in DuckDB SQL, for a
    repetition limit and the smallest whole budget."""
    rounds, last = [], "SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS width, false AS done"
    for k in range(ROUNDS):
        rounds.append(f"""b{k} AS ({last}),
g{k} AS (SELECT b.lo, b.width, b.done, k, b.lo + b.width * k / {GRID} AS a FROM b{k} b, range(0, {GRID + 1}) AS r(k)),
e{k} AS (SELECT g.lo, g.width, g.done, g.k, max(pow(p, a) / p) / min(pow(p, a) / p) <= {max_repeats} + {SLACK} AS ok
        FROM g{k} g, shares GROUP BY ALL)""")
        last = f"""SELECT CASE WHEN done OR hit = 0 THEN lo ELSE lo + width * (hit - 1) / {GRID} END AS lo,
       CASE WHEN done OR hit = 0 THEN 0.0 ELSE width / {GRID} END AS width, done OR hit = 0 AS done
       FROM (SELECT lo, width, done, coalesce(min(k) FILTER (ok), {GRID}) AS hit FROM e{k} GROUP BY lo, width, done)"""
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(source, '') AS src, coalesce(doc_id::VARCHAR, 'null') AS key,
                  coalesce(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS n_tokens
           FROM {table}),
t AS (SELECT *, (('0x' || substr(md5('{seed}|' || src || '|' || key), 1, 8))::BIGINT % {blocks})::INTEGER AS block FROM d),
totals AS (SELECT src, block, sum(n_tokens) AS tokens FROM t GROUP BY ALL HAVING sum(n_tokens) > 0),
shares AS (SELECT src, sum(tokens) AS t, sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM totals)::DOUBLE AS p FROM totals GROUP BY src),
{', '.join(rounds)},
found AS (SELECT lo + width AS a FROM ({last})),
low AS (SELECT min(pow(p, a) / p) AS lo FROM shares, found),
ratio AS (SELECT src, t, round(pow(p, a) / p * (1.0 / lo), 6) AS r FROM shares, found, low),
quota AS (SELECT src, t, floor(t::DOUBLE * r)::BIGINT AS q FROM ratio),
q AS (SELECT src, (q // t::BIGINT)::INTEGER AS epochs, q - (q // t::BIGINT) * t::BIGINT AS rest FROM quota),
x AS (SELECT totals.*, epochs, rest, unnest(range(0, epochs + 1))::INTEGER AS epoch FROM totals JOIN q USING (src)),
o AS (SELECT *, row_number() OVER w AS block_rank, sum(tokens) OVER w - tokens AS before FROM x
      WINDOW w AS (PARTITION BY src, epoch ORDER BY substr(md5('{seed}|' || epoch || '|' || src || '|' || block), 1, 16), block
                   ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, epoch < epochs OR before + tokens <= rest AS whole, rest - before AS room FROM o),
c AS (SELECT t.*, epoch, block_rank, room, sum(n_tokens) OVER (PARTITION BY t.src, t.block
             ORDER BY substr(md5('{seed}|' || epoch || '|' || t.src || '|' || key), 1, 16), key) AS upto
      FROM t JOIN k ON t.src = k.src AND t.block = k.block WHERE NOT whole AND room > 0 AND n_tokens > 0)
SELECT doc_id, source, n_tokens, epoch, t.block, block_rank::INTEGER AS block_rank
FROM t JOIN k ON t.src = k.src AND t.block = k.block WHERE whole AND n_tokens > 0
UNION ALL SELECT doc_id, source, n_tokens, epoch, block, block_rank::INTEGER FROM c WHERE upto <= room
UNION ALL SELECT doc_id, source, n_tokens, 0, block, NULL FROM t WHERE n_tokens = 0"""
