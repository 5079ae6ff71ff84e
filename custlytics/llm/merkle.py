"""Merkle manifest of a corpus, by nested-interval labels.

A document's leaf is the digest of its columns.  Each source is a tree over
its leaves in ascending ``doc_id``; every node carries the interval
``[lo, hi)`` of leaf ranks that it covers, so a node of height l lies in
bucket ``lo div FANOUT^l``.  Building goes up level by level: one aggregation
on (tree, bucket) of at most ``FANOUT`` rows a group.  Proofs go down level by
level: a node joins the node of the next level in whose bucket it falls and
whose interval contains its own; the parent's interval less the node's own
leaves its siblings, left and right.  The subroots are the leaves of one more
tree, whose root signs the corpus.

Rows move once a level and levels shrink by ``FANOUT``, so all of it is linear
in the documents; no key holds more than ``FANOUT`` rows, however large a
source is.  Ranks come from Spark's sort on (source, doc_id, leaf), so a
source that holds a third of all rows is spread over many tasks.  Each level
is written to the shared checkpoint folder.

Defined results: null columns digest as ``-`` and a null source is a tree of
its own, the first; null ids come first; rows of one id are ordered by their
leaf, equal rows keep a leaf each; empty texts are values of no bytes; an empty
table gives no rows and no root; other columns are ignored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custlytics.operators.rank import sorted_positions
from custlytics.session import materialize_table

FANOUT = 3
#: Columns that a leaf covers, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: dict[str, Column]) -> Column:
    return digest(*[field(columns[c]) for c in LEAF_COLUMNS])


def without_line_ends(columns: dict[str, Column]) -> Column:
    """The tampered leaf: where 2 divides the unsigned crc32 of the decimal
    doc_id, the text lost its line ends; null where nothing was changed."""
    chosen = F.crc32(columns["doc_id"].cast("string").cast("binary")) % 2 == 0
    text = columns["text"]
    return F.when(chosen & F.contains(text, F.lit("\n")), leaf_of({**columns, "text": F.replace(text, F.lit("\n"), F.lit(""))}))


@dataclass
class Tree:
    """Forest levels: ``levels[0]`` are the leaves (tree, size, lo, hi, digest
    and payload), ``levels[l]`` the nodes of height l (tree, size, lo, hi,
    digest, kids)."""
    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """(tree, digest) of each tree's topmost node: the only one of its level."""
        out = None
        for height, level in enumerate(self.levels):
            one = level.where(F.col("size") <= FANOUT ** height).select("tree", "digest")
            out = one if out is None else out.unionByName(one)
        return out


def grow(leaves: DataFrame, largest: int) -> Tree:
    """All levels over ``leaves``; ``largest`` is the size of the largest tree."""
    levels, span = [leaves], 1
    while span < largest:
        below, span = levels[-1].where(F.col("size") > span), span * FANOUT
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
        runs = below.groupBy("tree", "size", F.expr(f"lo div {span}").alias("bucket")).agg(kids.alias("kids"))
        level = runs.select("tree", "size", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"),
                            digest(F.array_join("kids.digest", "")).alias("digest"), "kids")
        levels.append(materialize_table(level, "merkle-level"))
    return Tree(levels)


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["digest"]), "")


def attach(tree: Tree, tops: DataFrame) -> DataFrame:
    """The leaves with ``path``, an array (left, right) of joined sibling
    digests from the leaf's own run upwards, followed by what ``tops`` (tree,
    path and other columns) says of the tree's topmost node; those other
    columns ride along."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    above: DataFrame | None = None
    for height in range(len(tree.levels) - 1, -1, -1):
        level, span = tree.levels[height], FANOUT ** height
        found = level.where(F.col("size") <= span).join(tops, "tree")
        if above is not None:
            node = level.where(F.col("size") > span).alias("node")
            up = above.select("tree", F.expr(f"lo div {span * FANOUT}").alias("bucket"), F.col("lo").alias("up_lo"),
                              F.col("hi").alias("up_hi"), F.col("kids").alias("up_kids"), F.col("path").alias("up_path"), *more).alias("up")
            inside = ((F.col("node.tree") == F.col("up.tree")) & (F.expr(f"node.lo div {span * FANOUT}") == F.col("up.bucket"))
                      & (F.col("up_lo") <= F.col("node.lo")) & (F.col("node.hi") <= F.col("up_hi")))
            left = F.filter("up_kids", lambda k: k["hi"] <= F.col("node.lo"))
            right = F.filter("up_kids", lambda k: k["lo"] >= F.col("node.hi"))
            step = F.struct(_joined(left).alias("left"), _joined(right).alias("right"))
            found = found.unionByName(node.join(up, inside).select(
                *[F.col(f"node.{c}") for c in level.columns], F.concat(F.array(step), F.col("up_path")).alias("path"), *more))
        # a level a job: its plan holds two joins, whatever the height of the tree
        above = materialize_table(found, "merkle-paths") if height else found
    return above


def _ranked(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with tree and rank interval, sources with their number), from
    one distributed sort."""
    placed = sorted_positions(leaves, ["source", "doc_id", "leaf", "tie"])
    # a row a (sorted partition, source): a source's share of each partition
    cells = materialize_table(placed.groupBy("__pid", "source").agg(
        F.count(F.lit(1)).alias("rows"), F.min("__pos").alias("first")), "merkle-cells")
    # a source lies in at most as many cells as there are partitions
    sources = cells.groupBy("source").agg(F.sum("rows").cast("long").alias("size"))
    numbered = sorted_positions(sources, ["source"])
    starts = numbered.groupBy("__pid").agg(F.count(F.lit(1)).alias("n"))   # a row a sorted partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = numbered.join(F.broadcast(starts.select("__pid", before.alias("before"))), "__pid").select(
        "source", "size", (F.col("before") + F.col("__pos")).alias("tree"))
    numbered = materialize_table(numbered, "merkle-sources")
    earlier = F.coalesce(F.sum("rows").over(
        Window.partitionBy("source").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("shift", earlier - F.col("first")).alias("cell").join(
        numbered.alias("s"), F.col("cell.source").eqNullSafe(F.col("s.source"))).select(
        F.col("cell.__pid").alias("pid"), F.col("s.source").alias("name"), "tree", "size", "shift")
    here = (F.col("__pid") == F.col("pid")) & F.col("source").eqNullSafe(F.col("name"))
    rank = (F.col("__pos") + F.col("shift")).cast("long")
    rows = placed.join(cells, here).select(
        "tree", "size", rank.alias("lo"), (rank + 1).alias("hi"), F.col("leaf").alias("digest"), "doc_id", "changed")
    return materialize_table(rows, "merkle-leaves"), numbered


@dataclass
class Manifest:
    """What signs a corpus: the trees of the sources, the tree of their
    subroots and its root (None without documents)."""
    sources: Tree
    top: Tree | None
    numbered: DataFrame
    root: str | None

    def nodes(self) -> DataFrame:
        """Every node: source, height, its interval of leaf ranks, digest."""
        out = None
        for height, level in enumerate(self.sources.levels):
            one = level.select("tree", F.lit(height).alias("height"), "lo", "hi", "digest")
            out = one if out is None else out.unionByName(one)
        return out.join(self.numbered.select("tree", "source"), "tree").drop("tree")


def build(docs: DataFrame, tamper: Callable[[dict[str, Column]], Column] = without_line_ends) -> Manifest:
    """The manifest of ``docs``.  ``tamper`` gives the leaf that a document
    has now where it is not the one signed, else null; it rides along."""
    columns = {c: F.col(f"`{c}`") for c in LEAF_COLUMNS}
    leaves = docs.select(columns["doc_id"].alias("doc_id"), columns["source"].alias("source"),
                         leaf_of(columns).alias("leaf"), tamper(columns).alias("changed"),
                         F.monotonically_increasing_id().alias("tie"))     # equal rows: splits them over tasks
    rows, numbered = _ranked(materialize_table(leaves, "merkle-digests"))
    largest, trees = numbered.agg(F.max("size"), F.count(F.lit(1))).first()
    sources = grow(rows, largest or 0)
    if not trees:
        return Manifest(sources, None, numbered, None)
    tops = sources.tops().select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("size"),
                                 F.col("tree").alias("lo"), (F.col("tree") + 1).alias("hi"), "digest")
    top = grow(materialize_table(tops, "merkle-subroots"), trees)
    return Manifest(sources, top, numbered, top.tops().first()["digest"])


def prove(spark: SparkSession, signed: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified,
    a row a document: siblings level by level up to the root, and the root
    that the document as it is now folds to with them."""
    if signed.top is None:
        leaves = signed.sources.levels[0].withColumns({"path": F.expr("cast(null AS array<struct<left: string, right: string>>)"),
                                                       "subroot": F.lit(None).cast("string")})
    else:
        none = spark.range(1).select(F.col("id").alias("tree"), F.expr("cast(array() AS array<struct<left: string, right: string>>)").alias("path"))
        up = attach(signed.top, none).select(F.col("lo").alias("tree"), F.col("digest").alias("subroot"), "path")
        leaves = attach(signed.sources, up)
    root = F.lit(signed.root).cast("string")
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    folded = F.aggregate("path", F.coalesce("changed", "digest"), lambda have, p: digest(p["left"], have, p["right"]))
    return leaves.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path",
                         digest(siblings).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame) -> DataFrame:
    """The digests of :func:`prove` over the manifest of ``docs``."""
    return prove(docs.sparkSession, build(docs)).drop("path")


def duckdb_sql(table: str = "documents", heights: int = 12) -> str:
    """The columns of :func:`manifest` in DuckDB SQL, for sources of at most
    3^heights documents."""
    def h(x):
        return f"sha256({x})"

    def f(c):
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    leaf = " || ".join(f(c) for c in LEAF_COLUMNS)
    cut = leaf.replace("text::VARCHAR", "replace(text, chr(10), '')")
    parts = [f"""
t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tbl),
d AS (SELECT doc_id, source, {h(leaf)} AS leaf,
             CASE WHEN xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
                               lambda c, b: xor(tbl[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 2 = 0
                  THEN {h(cut)} ELSE {h(leaf)} END AS present
      FROM {table}, t),
n0 AS (SELECT doc_id, leaf, present, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
              row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
l0 AS (SELECT tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM n0)"""]
    for side, last in (("l", heights), ("s", heights)):
        if side == "s":
            parts.append(f"s0 AS (SELECT 0 AS tree, tree AS i, h, count(*) OVER () AS n FROM l{heights})")
        for k in range(1, last + 1):
            b = f"{side}{k - 1}"
            # a tree of one node stays as it is
            parts.append(f"""{side}{k} AS MATERIALIZED (
  SELECT tree, i // 3 AS i, {h("string_agg(h, '' ORDER BY i)")} AS h, count(*) OVER (PARTITION BY tree) AS n FROM {b} WHERE n > 1 GROUP BY tree, i // 3
  UNION ALL SELECT tree, i, h, n FROM {b} WHERE n = 1)""")
    # each document's node and what it folds to, step by step
    parts.append("p0 AS (SELECT doc_id, leaf, tree AS source, tree, i, present AS have, '' AS proof FROM n0)")
    for at in range(2 * heights):
        b = f"l{at}" if at < heights else f"s{at - heights}"
        place = "0 AS tree, tree AS i" if at == heights else "tree, i"
        parts.append(f"""p{at + 1} AS MATERIALIZED (
  SELECT p.doc_id, p.leaf, p.source, p.tree, CASE WHEN x.n > 1 THEN p.i // 3 ELSE p.i END AS i,
         CASE WHEN x.n > 1 THEN {h("coalesce(s.lft, '') || p.have || coalesce(s.rgt, '')")} ELSE p.have END AS have,
         p.proof || coalesce(s.lft, '') || coalesce(s.rgt, '') AS proof
  FROM (SELECT doc_id, leaf, source, {place}, have, proof FROM p{at}) p JOIN {b} x ON x.tree = p.tree AND x.i = p.i LEFT JOIN (
    SELECT a.tree, a.i, string_agg(o.h, '' ORDER BY o.i) FILTER (o.i < a.i) AS lft, string_agg(o.h, '' ORDER BY o.i) FILTER (o.i > a.i) AS rgt
    FROM {b} a JOIN {b} o ON o.tree = a.tree AND o.i // 3 = a.i // 3 AND o.i <> a.i GROUP BY a.tree, a.i) s ON s.tree = p.tree AND s.i = p.i)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT p.doc_id, p.leaf, x.h AS subroot, r.h AS root, {h("p.proof")} AS proof_sha256, p.have AS folded_root, p.have = r.h AS verified
FROM p{2 * heights} p JOIN l{heights} x ON x.tree = p.source, s{heights} r"""
