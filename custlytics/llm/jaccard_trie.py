"""N-gram Jaccard join over whole texts by prefix trees.

Every text becomes a set of 64-bit hashes of its distinct 5-word shingles, put
in one global order: shingles that a fixed-size count table of the whole
corpus finds rare come first, ties by hash.  Texts with equal sets collapse
into one node.  Two sets with Jaccard 0.8 or more share a shingle in their
ordered prefixes, at positions that leave enough shingles to reach the needed
overlap, and in all as many prefix shingles as that overlap forces into both;
only such pairs are verified.

Verification walks a trie.  A probe's candidates, as globally ordered
sequences, are sorted by Spark, which is the depth-first order of their trie:
a sequence shares with its predecessor the path down to their common prefix,
its overlap with the probe is resumed from there, and a subtree is left as
soon as the remaining length cannot bring the overlap to the bound.

Groups of many near copies are not expanded into pairs.  First every set is
verified against one hub for each of its prefix shingles (the set with the
fewest shingles of its own), then against a neighbour in a hashed ring of the
shingle's sets, and connected components merge what is linked; after that only
pairs whose components still differ are verified, all of them.  No link
between components is lost, since a pair skipped lies in one component.

Defined results: null, empty and blank texts have no shingles and link with
nothing; a text under five words is one shingle; repeated rows share a node; a
component is named by its smallest non-null ``doc_id`` (null if it has none);
columns other than the id and the text play no part.

A node is a 64-bit hash of the set; a clash between two sets is detected with
a second hash and the corpus hashed again with another seed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlytics.llm.components import components
from custlytics.llm.tables import parallelism
from custlytics.session import materialize_table

#: Shingle length and least similarity in percent (fixed by the contract).
WIDTH, PERCENT = 5, 80
#: Counters of the rarity table (16 MB): its size never grows with the corpus.
SKETCH_BITS, SKETCH_CHUNKS = 22, 64
#: Count tables added up in one task.
MERGE_FAN_IN = 64
#: Ids up to which a set of documents is picked by a broadcast (16 bytes each).
BROADCAST_IDS = 1_000_000
#: Candidates of a probe that share one trie.
TRIE_SPLITS = 32
CACHE_WORDS = 1 << 19

M1, M2, STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def needed(a, b, percent: int = PERCENT):
    """Least overlap of linked sets of sizes a and b: percent * union / 100."""
    return -((-percent * (a + b)) // (100 + percent))


class Shingler:
    """Distinct shingle hashes of a text, ascending."""

    def __init__(self, seed: int = 0):
        self.seed, self.cache = seed, {}

    def words(self, text: str) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").lower().split()   # ASCII case and spaces only

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words(text) if text else []
        if not words:
            return np.empty(0, np.uint64)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w, self.seed)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        width = min(WIDTH, len(words))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = (out ^ h[k:len(h) - width + 1 + k]) * STEP
            out ^= out >> np.uint64(29)
        out = (out ^ (out >> np.uint64(30))) * M1
        out = (out ^ (out >> np.uint64(27))) * M2
        return np.unique(out ^ (out >> np.uint64(31)))


def _node(shingles: np.ndarray, seed: int) -> int:
    h = xxhash.xxh3_64_intdigest(shingles.tobytes(), seed)
    return h - (1 << 64) if h >> 63 else h


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _ordered(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The global order: rare first, ties by hash (the input ascends)."""
    return shingles[np.argsort(counts[_bucket(shingles)], kind="stable")]


_PROFILE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()),
    T.StructField("check", T.LongType()), T.StructField("task", T.IntegerType()),
    T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())])


def _profile(docs: DataFrame, seed: int) -> DataFrame:
    """A row for each document (size and hashes of its set) and, from each
    task, the chunks of its count table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shingler, table, task = Shingler(seed), np.zeros(1 << SKETCH_BITS, np.int32), TaskContext.get().partitionId()
        for batch in batches:
            n, node, check, parts = [], [], [], []
            for text in batch.column(1):
                s = shingler(text.as_py())
                n.append(len(s))
                node.append(_node(s, seed) if len(s) else None)
                check.append(_node(s, seed + 1) if len(s) else None)
                parts.append(_bucket(s))
            table += np.bincount(np.concatenate([np.empty(0, np.int64), *parts]), minlength=len(table)).astype(np.int32)
            none = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()),
                 none, none, pa.nulls(len(n), pa.binary())], names=_PROFILE.fieldNames())
        chunks = np.split(table, SKETCH_CHUNKS)
        gone = pa.nulls(SKETCH_CHUNKS, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [gone, gone, gone, gone, pa.array([task] * SKETCH_CHUNKS, pa.int32()), pa.array(range(SKETCH_CHUNKS), pa.int32()),
             pa.array([_pack(c.astype(np.int64)) for c in chunks], pa.binary())], names=_PROFILE.fieldNames())

    return docs.mapInArrow(run, _PROFILE)


def _pack(counts: np.ndarray) -> bytes:
    import zlib
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    import zlib
    return np.frombuffer(zlib.decompress(raw), "<i8")


def _count_table(profile: DataFrame) -> np.ndarray:
    """Sum of the tasks' count tables: fixed size, added in a tree of fan-in
    MERGE_FAN_IN, so no task sees more than that many."""
    part = profile.where("chunk IS NOT NULL").select("chunk", "task", "counts")
    tasks = (part.agg(F.max("task")).first()[0] or 0) + 1

    def add(pdf):
        return pdf.iloc[:1].assign(counts=_pack(np.sum([_unpack(c) for c in pdf["counts"]], axis=0)))

    while True:
        tasks = -(-tasks // MERGE_FAN_IN)
        part = part.withColumn("task", (F.col("task") / MERGE_FAN_IN).cast("int"))
        part = part.groupBy("chunk", "task").applyInPandas(add, "chunk int, task int, counts binary")
        if tasks == 1:
            break
    rows = {r["chunk"]: r["counts"] for r in part.collect()}
    if not rows:
        return np.zeros(1 << SKETCH_BITS, np.int32)
    most = np.iinfo(np.int32).max                            # the order needs no more than 32 bits
    return np.concatenate([np.minimum(_unpack(rows[c]), most).astype(np.int32) for c in range(SKETCH_CHUNKS)])


def _prefixes(docs: DataFrame, seed: int, counts, percent: int) -> DataFrame:
    """``node``, ``n`` and the ordered prefix of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table = Shingler(seed), counts.value
        for batch in batches:
            node, n, prefix = [], [], []
            for text in batch.column(0):
                s = shingler(text.as_py())
                if len(s):
                    node.append(_node(s, seed))
                    n.append(len(s))
                    prefix.append(_ordered(s, table)[:len(s) + (-percent * len(s)) // 100 + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(n, pa.int32()), _lists(prefix)], names=["node", "n", "prefix"])

    return docs.select("text").mapInArrow(run, "node bigint, n int, prefix array<bigint>")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def _sets(docs: DataFrame, seed: int, counts) -> DataFrame:
    """``node`` and its whole ordered set (8 bytes a shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table = Shingler(seed), counts.value
        for batch in batches:
            sets = [s for text in batch.column(0) if len(s := shingler(text.as_py()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(s, seed) for s in sets], pa.int64()),
                 pa.array([_ordered(s, table).astype(">u8").tobytes() for s in sets], pa.binary())], names=["node", "seq"])

    return docs.select("text").mapInArrow(run, "node bigint, seq binary")


class TrieWalk:
    """Overlap of one probe set with candidates in trie order."""

    BLOCK = 64

    def __init__(self, probe: np.ndarray, percent: int):
        self.probe, self.percent = np.sort(probe), percent
        self.path = np.empty(0, np.uint64)                   # the candidate above
        self.known = np.zeros(1, np.int64)                   # overlap at each depth walked of it

    def links(self, seq: np.ndarray) -> bool:
        m = min(len(self.path), len(seq))
        differ = np.flatnonzero(self.path[:m] != seq[:m])
        shared = min(int(differ[0]) if len(differ) else m, len(self.known) - 1)
        known = [self.known[:shared + 1]]
        depth, overlap = shared, int(self.known[shared])
        need = needed(len(self.probe), len(seq), self.percent)
        while depth < len(seq) and overlap + min(len(seq) - depth, len(self.probe) - overlap) >= need:
            step = seq[depth:depth + self.BLOCK]
            at = np.minimum(np.searchsorted(self.probe, step), len(self.probe) - 1)
            grown = overlap + np.cumsum(self.probe[at] == step)
            known.append(grown)
            depth, overlap = depth + len(step), int(grown[-1])
        self.path, self.known = seq, np.concatenate(known)
        return depth == len(seq) and overlap >= need


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (probe, cand) that link, by walking each probe's tries."""
    pairs = pairs.withColumn("split", F.pmod(F.xxhash64("cand"), F.lit(TRIE_SPLITS)).cast("int"))
    heads = pairs.select("probe", "split").distinct()
    rows = heads.join(sets, F.col("probe") == F.col("node")).select("probe", "split", F.lit(0).alias("role"), F.col("node").alias("cand"), "seq")
    rows = rows.unionByName(pairs.join(sets, F.col("cand") == F.col("node")).select(
        "probe", "split", F.lit(1).alias("role"), "cand", "seq"))
    rows = rows.repartition(parallelism(pairs.sparkSession), "probe", "split").sortWithinPartitions("probe", "split", "role", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, key = None, None
        for batch in batches:
            probe, split, role, cand = (batch.column(i).to_pylist() for i in range(4))
            out_a, out_b = [], []
            for i, seq in enumerate(batch.column(4)):
                seq = np.frombuffer(seq.as_py(), ">u8").astype(np.uint64)
                if role[i] == 0:
                    walk, key = TrieWalk(seq, percent), (probe[i], split[i])
                elif key == (probe[i], split[i]) and walk.links(seq):
                    out_a.append(probe[i])
                    out_b.append(cand[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _reachable(i, n, j, m, percent: int):
    """Whether sets of sizes n and m whose first common shingle is at i and j
    can reach the needed overlap (the remaining-length bound)."""
    need = (n + m).cast("long") * percent
    return ((n - i).cast("long") * (100 + percent) >= need) & ((m - j).cast("long") * (100 + percent) >= need)


@dataclass
class Links:
    """``profile`` (doc_id, n, node), ``edges`` (a, b: verified links between
    nodes), ``labels`` (node, label) of the linked nodes."""
    profile: DataFrame
    edges: DataFrame
    labels: DataFrame
    seed: int


def _pick(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is in ``ids`` (null matches null): by broadcast
    while the ids are few, else by a shuffled join."""
    ids = ids.select(F.col("doc_id").alias("__id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def link(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> Links:
    """Verified links and components of the texts of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for seed in range(0, 20, 2):
        everything = materialize_table(_profile(docs, seed), "profile")
        profile = everything.where("chunk IS NULL").select("doc_id", "n", "node", "check")
        nodes = materialize_table(profile.where("n > 0").groupBy("node").agg(
            F.min("doc_id").alias("first_id"), (F.min("check") != F.max("check")).alias("clash")), "nodes")
        if not nodes.where("clash").limit(1).count():
            break
    else:
        raise RuntimeError("set hashes clash under every seed")
    counts = spark.sparkContext.broadcast(_count_table(everything))

    # prefix shingles that two nodes or more share, with each node's position
    prefix = _prefixes(docs, seed, counts, percent).groupBy("node").agg(
        F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    entries = prefix.select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    shared = entries.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).where("df > 1")
    shared = materialize_table(_with_partner(shared.select("shingle", "node", "n", "pos"), percent), "shared")
    apt = shared.where("partner").drop("partner")
    held = materialize_table(shared.groupBy("node").agg(F.first("n").alias("n"), F.collect_list("shingle").alias("held")), "held")

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs that share enough prefix shingles, and those that link."""
        pairs = materialize_table(_promising(pairs, held, percent), "pairs")
        who = pairs.select(F.col("probe").alias("node")).union(pairs.select("cand")).distinct()
        ids = who.join(nodes, "node").select(F.col("first_id").alias("doc_id"))
        sets = _sets(_pick(docs, ids), seed, counts).join(who, "node", "left_semi")
        sets = materialize_table(sets.groupBy("node").agg(F.first("seq").alias("seq")), "sets")
        return pairs, materialize_table(_verify(pairs, sets, percent), "links")

    tried, edges = verified(_hub_pairs(apt, percent))
    labels = components(edges)
    ring, more = verified(_untried(_ring_pairs(_open(apt, labels), percent), tried))
    if more.limit(1).count():
        edges = edges.union(more)
        labels = components(edges)
    rest, more = verified(_untried(_open_pairs(_open(apt, labels), percent), tried, ring))
    if more.limit(1).count():
        edges = edges.union(more)
        labels = components(edges)
    return Links(profile.select("doc_id", "n", "node"), edges, labels, seed)


def _with_partner(shared: DataFrame, percent: int) -> DataFrame:
    """Mark entries for which another node of the shingle is neither too large
    nor too far from its start: ``cap`` is the largest set that a node can
    still link with if this is their first common shingle."""
    e = shared.withColumn("cap", F.floor((F.col("n") - F.col("pos")).cast("long") * (100 + percent) / percent) - F.col("n"))
    of = Window.partitionBy("shingle")
    by_cap, by_n = of.orderBy(F.desc("cap"), "node"), of.orderBy("n", "node")
    e = e.withColumns({
        "cap_of_others": F.when(F.row_number().over(by_cap) == 1, F.lead("cap").over(by_cap)).otherwise(F.first("cap").over(by_cap)),
        "n_of_others": F.when(F.row_number().over(by_n) == 1, F.lead("n").over(by_n)).otherwise(F.first("n").over(by_n))})
    return e.withColumn("partner", (F.col("cap_of_others") >= F.col("n")) & (F.col("n_of_others") <= F.col("cap"))).select(
        "shingle", "node", "n", "pos", "partner")


def _promising(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs with enough common prefix shingles.  Of sets that overlap in
    o shingles the k-th common one stands before k + n - o in the order of a
    set of n, so the first o + 1 - ceil(percent * n / 100) of them, n the
    larger size, stand in both prefixes."""
    a = held.select(F.col("node").alias("probe"), F.col("n").alias("np"), F.col("held").alias("hp"))
    b = held.select(F.col("node").alias("cand"), F.col("n").alias("nc"), F.col("held").alias("hc"))
    common = pairs.join(a, "probe").join(b, "cand").withColumn("common", F.size(F.array_intersect("hp", "hc")))
    overlap = F.ceil((F.col("np") + F.col("nc")).cast("long") * percent / (100 + percent))
    least = overlap + 1 - F.ceil(F.greatest("np", "nc").cast("long") * percent / 100)
    return common.where(F.col("common") >= least).select("probe", "cand")


def _untried(pairs: DataFrame, *tried: DataFrame) -> DataFrame:
    """The pairs that were not verified yet, in either direction."""
    for t in tried:
        known = t.select(F.least("probe", "cand").alias("lo"), F.greatest("probe", "cand").alias("hi"))
        pairs = pairs.join(known, (F.least("probe", "cand") == F.col("lo")) & (F.greatest("probe", "cand") == F.col("hi")), "left_anti")
    return pairs


def _hub_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Each node with the hub of each of its shared prefix shingles: the node
    with the largest share of shared shingles in its prefix, so a text that
    others were copied from rather than a copy with words of its own."""
    typical = shared.groupBy("node").agg((F.count(F.lit(1)) / F.max("n")).alias("typical"))
    scored = shared.join(typical, "node")
    hub = scored.groupBy("shingle").agg(F.max(F.struct("typical", "node", "n", "pos")).alias("hub"))
    pairs = shared.join(hub, "shingle").where(F.col("node") != F.col("hub.node")).where(
        _reachable(F.col("pos"), F.col("n"), F.col("hub.pos"), F.col("hub.n"), percent))
    # the hub probes: its candidates share tries
    return pairs.select(F.col("hub.node").alias("probe"), F.col("node").alias("cand")).distinct()


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The shared entries, labelled, of shingles whose nodes are not all in
    one component."""
    out = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of = Window.partitionBy("shingle")
    return out.withColumns({"lo": F.min("label").over(of), "hi": F.max("label").over(of)}).where("lo <> hi").drop("lo", "hi")


def _ring_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each node with the next one of its shingle in hashed order."""
    ring = Window.partitionBy("shingle").orderBy(F.xxhash64("node", "shingle"), "node")
    near = F.lead(F.struct("node", "n", "pos", "label")).over(ring)
    return entries.withColumn("near", near).where("near IS NOT NULL AND near.label <> label").where(
        _reachable(F.col("pos"), F.col("n"), F.col("near.pos"), F.col("near.n"), percent)).select(
        F.least("node", "near.node").alias("probe"), F.greatest("node", "near.node").alias("cand")).distinct()


def _open_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes in different components that share a prefix shingle
    and can reach the needed overlap from there."""
    e = materialize_table(entries, "open")
    a, b = (e.select(*[F.col(c).alias(f"{p}_{c}") for c in e.columns]) for p in "ab")
    on = (F.col("a_shingle") == F.col("b_shingle")) & (F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label"))
    return a.join(b, on & _reachable(F.col("a_pos"), F.col("a_n"), F.col("b_pos"), F.col("b_n"), percent)).select(
        F.col("a_node").alias("probe"), F.col("b_node").alias("cand")).distinct()


def _named(found: Links) -> DataFrame:
    """``node``, ``component_id``: smallest document id of every linked node's component."""
    ids = found.profile.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    marked = ids.join(found.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = marked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return marked.join(names, "label").select("node", "label", "component_id")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    found = link(docs, doc_id=doc_id, text=text, percent=percent)
    named = _named(found).select(F.col("node").alias("__node"), "component_id")
    full = found.profile.where("node IS NOT NULL").join(named, F.col("node") == F.col("__node"))
    bare = found.profile.where("node IS NULL")
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(
        bare.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each component, with its own columns: the row of the smallest
    ``doc_id`` (a null id only if the component has no other; among rows of
    one id and one component any one, as their sets are equal or linked).
    Rows without shingles all stay."""
    found = link(docs, doc_id=doc_id, text=text, percent=percent)
    profile = found.profile.join(_named(found).select(F.col("node").alias("__node"), "label", "component_id"),
                                 F.col("node") == F.col("__node"), "left")
    rows = profile.select("doc_id", "node", "label", "component_id")
    rows = materialize_table(rows, "rows")
    twice = materialize_table(rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"), "twice")
    names = docs.columns
    docs = docs.withColumn("__id", F.col(f"`{doc_id}`").cast("long"))
    winners = rows.where("node IS NULL OR doc_id = component_id").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__w"))
    single = winners
    if twice.limit(1).count():
        single = winners.join(twice, F.col("__w") == F.col("doc_id"), "left_anti")
    out = docs.join(single, F.col("__id") == F.col("__w"), "left_semi").select(*[F.col(f"`{c}`") for c in names])
    if not twice.limit(1).count():
        return out
    # ids that several rows carry: name their rows' sets and keep one a component
    few = docs.join(twice.select(F.col("doc_id").alias("__t")), F.col("__id").eqNullSafe(F.col("__t")), "left_semi")
    seed, schema = found.seed, T.StructType([*few.schema.fields, T.StructField("__node", T.LongType())])
    at = few.columns.index(text)

    def run(batches):
        shingler = Shingler(seed)
        for batch in batches:
            sets = [shingler(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([_node(s, seed) if len(s) else None for s in sets], pa.int64())], names=schema.fieldNames())

    few = few.mapInArrow(run, schema)
    labels = rows.where("node IS NOT NULL").select(F.col("node").alias("__n"), F.col("label").alias("__label"),
                                                   F.col("component_id").alias("__c")).distinct()
    linked = few.where("__node IS NOT NULL").join(labels, F.col("__node") == F.col("__n")).where(
        F.col("__id").eqNullSafe(F.col("__c"))).dropDuplicates(["__label"])
    pick = [F.col(f"`{c}`") for c in names]
    return out.union(linked.select(*pick)).union(few.where("__node IS NULL").select(*pick))
