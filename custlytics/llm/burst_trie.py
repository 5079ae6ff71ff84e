"""Prefix trie of conversations, built by bursting.

A turn is named by 16 bytes of the SHA-256 of its role and text, a
conversation by the string of its turns' names, so byte order is trie order.
Equal conversations are counted together first.  A container holds the
suffixes under one trie head.  All start in the root's container; one that
holds more than ``BURST_TURNS`` turns bursts: its common prefix becomes a chain
of nodes, and its suffixes move to the containers of their next turn.  Rounds
end when no container is too large; the rest are dealt over the tasks by their
head, sorted, and swept into nodes once, neighbour by neighbour.  Sums over
subtrees go up through the burst heads, last round first.

A round moves only the suffixes of containers that burst, so a first turn that
a third of all conversations share costs one more round for those.  Sizes,
common prefixes and sums are aggregated before they are shuffled.  The digest
of the conversations that end at a node streams over their sorted ids, which
arrive joined in pieces; nothing holds them together, however many copies a
conversation has.  What one task must hold is a container, or a single
conversation's names (20 bytes a turn).  Rounds are at most the number of
branchings on one path among containers too large, usually two or three.

Defined results: a null role or text counts as empty; turns are ordered by
number, null first, rows of one number by their names (repeated rows stay
repeated turns); rows without a conv_id belong to no conversation and are left
out; an empty table has no nodes; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlytics.plans.broadcast import broadcast_if_small
from custlytics.session import materialize_table

#: Turns that a container of several conversations may hold.
BURST_TURNS = 4096
#: Bytes of a turn's name; ids joined in one row on the way to a digest.
NAME, PIECE_IDS = 16, 512
#: Containers that burst in one round up to which their heads are broadcast.
BROADCAST_HEADS = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

# ---- fixed values ----------------------------------------------------------
#: A conversation starts with up to h turns of the first of its hundred, h below SHARED.
HUNDRED, SHARED = 100, 6
# ----------------------------------------------------------------------------

NODES = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("parent_conv_id", T.LongType()),
    T.StructField("n_convs", T.LongType()), T.StructField("n_children", T.LongType()), T.StructField("n_leaves", T.LongType()),
    T.StructField("saved_tokens", T.LongType()), T.StructField("ends_sha256", T.StringType())])


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, path (names of its turns), chars (code points of their texts)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    spelled = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.substring(F.sha2(spelled.cast("binary"), 256), 1, 2 * NAME).alias("name"),
                 F.length(text).alias("chars")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))   # one conversation a row
    return whole.select("conv_id", F.unhex(F.array_join("t.name", "")).alias("path"), F.col("t.chars").alias("chars"))


def rebuild(convs: DataFrame) -> DataFrame:
    """Each conversation c as the first h turns of conversation c - c % 100
    (all if fewer, none if absent), then its own after its first h; h is the
    unsigned crc32 of c in decimals, modulo 6."""
    first = (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("first")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int").alias("h")
    some = convs.where(F.col("conv_id") % HUNDRED == 0).select(
        F.col("conv_id").alias("first"), F.substring("path", 1, NAME * (SHARED - 1)).alias("lead"),
        F.slice("chars", 1, SHARED - 1).alias("lead_chars"))
    both = convs.select("*", first, h).join(some, "first", "left")
    nothing = F.expr("cast(array() AS array<int>)")
    path = F.concat(F.coalesce(F.expr(f"substring(lead, 1, {NAME} * h)"), F.unhex(F.lit(""))), F.expr(f"substring(path, {NAME} * h + 1)"))
    chars = F.concat(F.coalesce(F.slice("lead_chars", 1, F.col("h")), nothing), F.slice("chars", F.col("h") + 1, F.greatest(F.size("chars"), F.lit(1))))
    return both.select("conv_id", path.alias("path"), chars.alias("chars"))


def _key(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 2 * NAME)


def end_digests(convs: DataFrame) -> DataFrame:
    """seq (key of a whole path), n (its conversations), conv (smallest),
    ends (SHA-256 of their ids in order, joined by commas)."""
    pieces = T.StructType([T.StructField("seq", T.StringType()), T.StructField("first", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("ids", T.StringType())])
    digests = T.StructType([T.StructField("seq", T.StringType()), T.StructField("n", T.LongType()),
                            T.StructField("conv", T.LongType()), T.StructField("ends", T.StringType())])

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, at = [], 0
            while at < len(seqs):
                to = at + 1
                while to < len(seqs) and to - at < PIECE_IDS and seqs[to] == seqs[at]:
                    to += 1
                out.append((seqs[at], ids[at], to - at, ",".join(map(str, ids[at:to]))))
                at = to
            yield pa.RecordBatch.from_arrays(_columns(out, pieces), names=pieces.fieldNames())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, conv, sha = None, 0, None, None
        for batch in batches:
            out = []
            for seq, first, more, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seq != now:
                    if now is not None:
                        out.append((now, n, conv, sha.hexdigest()))
                    now, n, conv, sha = seq, more, first, hashlib.sha256(ids.encode())
                else:
                    n += more
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays(_columns(out, digests), names=digests.fieldNames())
        if now is not None:
            yield pa.RecordBatch.from_arrays(_columns([(now, n, conv, sha.hexdigest())], digests), names=digests.fieldNames())

    ids = convs.select(_key(F.col("path")).alias("seq"), "conv_id")
    sorted_ids = ids.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    joined = sorted_ids.mapInArrow(join_ids, pieces)
    return joined.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(digest, digests)


def _columns(rows: list[tuple], schema: T.StructType) -> list[pa.Array]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = list(zip(*rows)) or [()] * len(schema)
    return [pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema, strict=True)]


def sweep(depth: int, up: int | None, seqs: list[tuple[bytes, list[int], int, int, str]]) -> list[list]:
    """Nodes under the head at ``depth`` of sorted distinct sequences (path,
    chars, n, conv, ends), in depth-first order: [conv, depth, parent's conv,
    n, children, leaves, saved, ends]."""
    nodes, above, size = [], [], []                      # above: the parent's place; size: last text's code points
    stack: list[int] = []                                # places of the nodes from the head to the last sequence's end
    last = None
    for path, chars, n, conv, ends in seqs:
        turns, common = len(path) // NAME, depth
        if last is not None:
            most = min(len(last), len(path)) // NAME
            while common < most and last[common * NAME:(common + 1) * NAME] == path[common * NAME:(common + 1) * NAME]:
                common += 1
            del stack[common - depth + 1:]
        for d in range(depth if last is None else common + 1, turns + 1):
            above.append(stack[-1] if stack else -1)
            stack.append(len(nodes))
            size.append(chars[d - 1] if d else 0)
            nodes.append([conv, d, None, 0, 0, 0, 0, NO_ENDS])
        end = nodes[stack[-1]]
        end[3], end[7] = n, ends
        end[0] = min(end[0], conv)
        last = path
    for at in range(len(nodes) - 1, -1, -1):             # children come after their parents
        node = nodes[at]
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * size[at]
        if above[at] >= 0:
            parent = nodes[above[at]]
            parent[0] = min(parent[0], node[0])
            parent[3] += node[3]
            parent[4] += 1
            parent[5] += node[5]
            parent[6] += node[6]
    for at, node in enumerate(nodes):
        node[2] = nodes[above[at]][0] if above[at] >= 0 else up
    return nodes


def _sweep_boxes(rows: DataFrame) -> DataFrame:
    """Nodes of every container, with the container from which it burst
    (``parent``; null below a container's head)."""
    schema = T.StructType([*NODES.fields, T.StructField("top", T.BooleanType()), T.StructField("parent", T.StringType())])

    def made(box, depth, up, parent, seqs) -> pa.RecordBatch:
        nodes = sweep(depth, up, seqs)
        top = [n[1] == depth for n in nodes]
        return pa.RecordBatch.from_arrays(
            [*_columns([tuple(n) for n in nodes], NODES), pa.array(top, pa.bool_()),
             pa.array([parent if t else None for t in top], pa.string())], names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, seqs = None, []
        for batch in batches:
            for box, depth, up, parent, *seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head is None or head[0] != box:
                    if head is not None:
                        yield made(*head, seqs)
                    head, seqs = (box, depth, up, parent), []
                seqs.append(seq)
        if head is not None:
            yield made(*head, seqs)

    ordered = rows.select("box", "depth", "up", "parent", "path", "chars", "n", "conv", "ends")
    return ordered.repartition("box").sortWithinPartitions("box", "path").mapInArrow(run, schema)


def _common_turns(a: str, b: str) -> Column:
    """Turns that two paths share from the start."""
    least = f"(least(length({a}), length({b})) div {NAME})"
    same = f"transform(sequence(1, {least}), i -> substring({a}, {NAME} * (i - 1) + 1, {NAME}) = substring({b}, {NAME} * (i - 1) + 1, {NAME}))"
    return F.expr(f"CASE WHEN {least} = 0 THEN 0 WHEN array_position({same}, false) = 0 THEN {least} "
                  f"ELSE array_position({same}, false) - 1 END").cast("int")


def trie(convs: DataFrame, burst_turns: int = BURST_TURNS) -> DataFrame:
    """A row a node of the trie over conversations (conv_id, path, chars):
    the columns of ``NODES``."""
    convs = materialize_table(convs, "trie-conversations")
    paths = convs.withColumnRenamed("conv_id", "conv")
    # the smallest conversation of each path stands for it
    seqs = end_digests(convs).join(paths, "conv").select(
        F.lit("").alias("box"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("up"), F.lit(None).cast("string").alias("parent"),
        "path", "chars", "n", "conv", "ends")
    rows, kept, burst = materialize_table(seqs, "trie-sequences"), None, []
    while True:
        sizes = rows.groupBy("box", "depth", "up", "parent").agg(
            F.sum(F.size("chars") - F.col("depth")).alias("turns"), F.count(F.lit(1)).alias("seqs"), F.sum("n").alias("n"),
            F.min("conv").alias("conv"), F.min(F.struct("path", "chars", "ends")).alias("low"), F.max("path").alias("high"))
        over = sizes.where((F.col("turns") > burst_turns) & (F.col("seqs") > 1)).withColumn("to", _common_turns("low.path", "high"))
        over = materialize_table(over, "trie-burst")
        heads = over.select("box", "to", F.col("conv").alias("head_conv"))
        if not over.limit(1).count():
            kept = rows if kept is None else kept.unionByName(rows)
            break
        burst.append(over)
        # beyond the checked size a shuffle join, whose hot container adaptive execution splits
        told = rows.join(broadcast_if_small(heads, BROADCAST_HEADS), "box", "left")
        stay = told.where(F.col("to").isNull()).select(*rows.columns)
        kept = stay if kept is None else kept.unionByName(stay)
        moved = told.where(F.length("path") > NAME * F.col("to")).select(
            _key(F.expr(f"substring(path, 1, {NAME} * (to + 1))")).alias("box"), (F.col("to") + 1).alias("depth"),
            F.col("head_conv").alias("up"), F.col("box").alias("parent"), "path", "chars", "n", "conv", "ends")
        rows = materialize_table(moved, "trie-sequences")
    swept = materialize_table(_sweep_boxes(kept), "trie-nodes")
    return _with_heads(swept, burst)


def _with_heads(swept: DataFrame, burst: list[DataFrame]) -> DataFrame:
    """The swept nodes and those of the containers that burst."""
    out = swept.select(*NODES.fieldNames())
    tops = swept.where("top").select("parent", "n_leaves", "saved_tokens")
    below = None                                         # what the later round's containers pass up
    for over in reversed(burst):
        kids = tops if below is None else tops.unionByName(below)
        sums = kids.groupBy("parent").agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        heads = over.join(sums.withColumnRenamed("parent", "of"), F.col("box") == F.col("of"))
        chain = heads.select("*", F.explode(F.sequence("depth", "to")).alias("d"))
        chain = chain.withColumn("own", (F.col("n") - 1) * F.when(F.col("d") > 0, F.get(F.col("low.chars"), F.col("d") - 1)).otherwise(0))
        down = Window.partitionBy("box").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
        last = F.col("d") == F.col("to")
        ended = last & (F.length("low.path") == NAME * F.col("to"))
        chain = materialize_table(chain.select(
            F.col("conv").alias("conv_id"), F.col("d").cast("long").alias("depth"),
            F.when(F.col("d") == F.col("depth"), F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"),
            F.col("n").cast("long").alias("n_convs"), F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
            F.col("leaves").cast("long").alias("n_leaves"),
            (F.col("saved") + F.sum("own").over(down)).cast("long").alias("saved_tokens"),
            F.when(ended, F.col("low.ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
            F.when(F.col("d") == F.col("depth"), F.col("parent")).alias("parent")), "trie-heads")
        below = chain.where("parent IS NOT NULL").select("parent", "n_leaves", "saved_tokens")
        out = out.unionByName(chain.select(*NODES.fieldNames()))
    return out


def duckdb_sql(table: str = "conversations") -> str:
    """The nodes of the rebuilt conversations in DuckDB SQL."""
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tbl),
own AS (SELECT conv_id, list({{'x': x, 'n': n}} ORDER BY turn NULLS FIRST, x) AS turns FROM (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
         length(coalesce(text, ''))::BIGINT AS n FROM {table} WHERE conv_id IS NOT NULL) GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % {HUNDRED} AS first,
             xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
                     lambda c, b: xor(tbl[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % {SHARED} AS h FROM own, t),
r AS (SELECT h.conv_id, list_concat(coalesce(f.turns[1:h], []), h.turns[h + 1:]) AS turns FROM h LEFT JOIN own f ON f.conv_id = h.first),
p AS MATERIALIZED (SELECT conv_id, d, len(turns) AS size, coalesce(turns[d].n, 0) AS n,
             array_to_string(list_transform(turns[1:d], lambda u: u.x), '') AS path FROM r, range(0, (SELECT max(len(turns)) + 1 FROM r)) AS g(d) WHERE d <= len(turns)),
n AS MATERIALIZED (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends FROM p GROUP BY d, path),
u AS MATERIALIZED (SELECT n.*, up.conv_id AS parent_conv_id, up.path AS up_path
      FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.d = n.d - 1 LEFT JOIN n up ON up.d = q.d AND up.path = q.path),
k AS (SELECT d - 1 AS d, up_path AS path, count(*) AS kids FROM u WHERE d > 0 GROUP BY ALL),
s AS (SELECT a.d, a.path, count(*) FILTER (k.kids IS NULL) AS leaves, sum((b.n_convs - 1) * b.n) AS saved
      FROM n b JOIN p q ON q.conv_id = b.conv_id AND q.d <= b.d JOIN n a ON a.d = q.d AND a.path = q.path
      LEFT JOIN k ON k.d = b.d AND k.path = b.path GROUP BY a.d, a.path)
SELECT u.conv_id, u.d::BIGINT AS depth, u.parent_conv_id, u.n_convs, coalesce(k.kids, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, u.ends AS ends_sha256
FROM u JOIN s USING (d, path) LEFT JOIN k ON k.d = u.d AND k.path = u.path"""
