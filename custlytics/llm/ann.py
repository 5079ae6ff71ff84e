"""Approximate nearest neighbours by balanced posting lists.

Centroids come from k-means on a bounded sample, with large clusters split
again so that lists stay even.  Every vector goes to the list of its nearest
centroid and, where it lies near a boundary, to the lists of others whose
distance is within ``boundary`` of the nearest, unless a kept centroid lies
nearer to it than the vector does.  A query finds its lists by
best-first search in an in-memory graph of centroids and takes all whose
distance is within ``ratio`` of the nearest.  Both are chosen by trial on the
sample the centroids come from: of the pairs at which sample queries find
``RECALL`` of their true neighbours in the sample, the one that scans least
(:func:`tune`); copies pay where vectors cluster and cost where they do not.
The sample is sparser than the table, so its neighbours are farther apart and
the trial errs on the side of recall.  The nearest list is scanned first; its last rank bounds what the others may add, so they send only rows
that could enter the result.  Queries that have found fewer than ``top`` ids
then go to the next nearest lists, ``WIDEN`` times as many each round, until
they have them or all lists are scanned.

Lists are scanned in blocks: (list, block of vectors, block of queries) is one
group of bounded size however many vectors or queries a list draws, so a
common vector only makes more groups.  Scores are exact cosines in double
precision on the original vectors; ties go to the smaller id.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components, rows without an id, and vectors of another length than
the most common one (the smaller, if tied) take no part; equal rows count
once, an id of several vectors at its best score; a query has as many rows as
there are candidates, up to ``top``; an empty table gives an empty result."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custlytics.session import materialize_table

#: Rows of the sample that centroids are fitted on (the index holds every row).
SAMPLE_ROWS = 16_384
#: Vectors a list should hold, most centroids (bounds what is broadcast).
LIST_ROWS, MOST_CENTROIDS = 300, 2_048
DEGREE = 16
#: Boundaries and ratios to choose from, sample queries of the trial, recall it asks for.
BOUNDARIES = (0.01, 0.02, 0.05, 0.1)
RATIOS = (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18, 0.2, 0.22, 0.24, 0.26, 0.28, 0.3, 0.35, 0.4, 0.5, 0.7, 1.0)
TRIALS, RECALL = 256, 0.93
#: Vectors and queries of one group.
VECTOR_BLOCK, QUERY_BLOCK = 512, 1_024
TOP = 5
#: Lists of the first round for queries short of results, and the factor of the later ones.
FIRST_LISTS, WIDEN = 8, 4
#: Vectors that are routed at once, and most rows these become.
ROUTE_BLOCK, ROUTE_ROWS = 1_024, 65_536
NEAR = 1e-9


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``vec`` (array<double>) of the rows that take part."""
    v = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    v = v.where(F.col("vec_id").isNotNull() & _usable(F.col("vec")))
    sizes = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v if sizes is None else v.where(F.size("vec") == sizes["d"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)             # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors whose squares would overflow or vanish, scaled by their largest component."""
    most = np.abs(x).max(axis=1, keepdims=True)
    return x / np.where((most > 1e100) | (most < 1e-100), most, 1.0)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ c.T)))


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


class Centroids:
    """Centroids and their neighbour graph; bounded by MOST_CENTROIDS."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        c = _kmeans(sample, min(k, len(sample)), rng)
        near = (sample @ c.T).argmax(axis=1)
        mean, parts = len(sample) / len(c), []
        for j in range(len(c)):                              # even lists: split what is large
            own = sample[near == j]
            pieces = int(len(own) // (2 * mean)) + 1 if len(own) > 2 * mean else 1
            distinct = np.unique(own, axis=0) if pieces > 1 else own
            parts.append(_kmeans(distinct, min(pieces, len(distinct)), rng) if pieces > 1 and len(distinct) > 1 else c[j:j + 1])
        self.c = np.unique(np.concatenate(parts), axis=0)
        d = _distances(self.c, self.c)
        self.between = d
        links = [set() for _ in self.c]
        for i, near in enumerate(np.argsort(d, axis=1, kind="stable")[:, 1:DEGREE + 1].tolist()):
            for j in near:
                links[i].add(j)
                links[j].add(i)
        # a chain over all centroids keeps the graph in one piece
        for i in range(len(links) - 1):
            links[i].add(i + 1)
            links[i + 1].add(i)
        self.links = [np.array(sorted(x), np.int64) for x in links]
        self.entries = np.linspace(0, len(self.c) - 1, num=min(8, len(self.c))).astype(int)

    def search(self, q: np.ndarray, ratio: float) -> list[int]:
        """Centroids within (1 + ratio) times the nearest distance, by
        best-first search of the graph."""
        seen = np.zeros(len(self.c), bool)
        heap: list[tuple[float, int]] = []
        found: list[tuple[float, int]] = []
        best = np.inf

        def look(nodes):
            nodes = nodes[~seen[nodes]]
            seen[nodes] = True
            if len(nodes):
                for d, j in zip(_distances(q[None], self.c[nodes])[0].tolist(), nodes.tolist(), strict=True):
                    heapq.heappush(heap, (d, j))

        look(self.entries)
        patience = DEGREE
        while heap:
            d, j = heapq.heappop(heap)
            best = min(best, d)
            found.append((d, j))
            if d > (1 + ratio) * best + 1e-12:
                patience -= 1                                # a few steps past the bound, out of local minima
                if not patience:
                    break
            look(self.links[j])
        return [j for d, j in sorted(found) if d <= (1 + ratio) * best + 1e-12]

    def nearest(self, x: np.ndarray, start: int, stop: int) -> list[list[int]]:
        """Lists of each vector from place ``start`` to before ``stop``, by distance."""
        return np.argsort(_distances(x, self.c), axis=1, kind="stable")[:, start:stop].tolist()

    def lists(self, x: np.ndarray, slack: float) -> list[list[int]]:
        """Lists of each vector: the nearest, and boundary replicas."""
        d = _distances(x, self.c)
        out = []
        for row in range(len(x)):
            near = np.flatnonzero(d[row] <= (1 + slack) * d[row].min() + 1e-12)
            near = near[np.argsort(d[row][near], kind="stable")].tolist()
            kept = near[:1]
            for j in near[1:]:
                if all(self.between[j, i] >= d[row, j] for i in kept):
                    kept.append(j)
            out.append(kept)
        return out


def tune(centroids: Centroids, sample: np.ndarray, top: int = TOP, recall: float = RECALL) -> tuple[float, float]:
    """Boundary and ratio with the least scanned rows of those that reach
    ``recall`` for every (n / TRIALS)-th vector of the sample, others as
    candidates; ties go to fewer copies.  The widest pair, if none does.
    Recall counts by similarity, so equal neighbours stand for each other."""
    asked = np.unique(np.linspace(0, len(sample) - 1, num=min(TRIALS, len(sample))).astype(int))
    top = min(top, len(sample) - 1)
    if top < 1 or len(centroids.c) == 1:
        return BOUNDARIES[0], RATIOS[0]
    far = _distances(sample[asked], centroids.c)
    far = far / np.maximum(far.min(axis=1, keepdims=True), 1e-12)
    s = sample[asked] @ sample.T
    s[np.arange(len(asked)), asked] = -np.inf
    floor = -np.partition(-s, top - 1, axis=1)[:, top - 1] - NEAR
    best = None
    for boundary in BOUNDARIES:
        lists = centroids.lists(sample, boundary)
        member = np.zeros((len(sample), len(centroids.c)), bool)
        member[np.repeat(np.arange(len(sample)), [len(x) for x in lists]), [j for x in lists for j in x]] = True
        sizes = member.sum(axis=0)
        for ratio in RATIOS:
            probed = far <= 1 + ratio
            scanned = int((probed @ sizes).sum())
            if best and scanned >= best[0]:
                break                                        # wider ratios scan no less
            found = sum(min(top, int(member[near][:, probed[i]].any(axis=1).sum()))
                        for i, near in enumerate(np.flatnonzero(x >= f) for x, f in zip(s, floor, strict=True)))
            if found >= recall * top * len(asked):
                best = (scanned, boundary, ratio)
                break
    return best[1:] if best else (BOUNDARIES[-1], RATIOS[-1])


def fit(vecs: DataFrame, sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, top: int = TOP) -> Centroids | None:
    """Centroids of the table with the ``boundary`` and ``ratio`` to use them
    at, or None if it is empty."""
    n = vecs.count()
    if not n:
        return None
    rows = vecs.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample_rows).select("vec").toArrow()
    flat = rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sample = _unit(flat.reshape(len(rows), -1))
    centroids = Centroids(sample, max(1, min(MOST_CENTROIDS, n // list_rows)))
    centroids.boundary, centroids.ratio = tune(centroids, sample, top)
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _route(df: DataFrame, index, choose, step: int = ROUTE_BLOCK) -> DataFrame:
    """(list, place, id, vec): a row for each list that ``choose`` names,
    nearest first; ``step`` vectors at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = choose(centroids, _unit(_matrix(part.column(1))))
                rows = np.repeat(np.arange(part.num_rows), [len(x) for x in lists])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([j for x in lists for j in x], pa.int32()), pa.array([k for x in lists for k in range(len(x))], pa.int32()),
                     part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))], names=["list", "place", "id", "vec"])

    return df.mapInArrow(run, "list int, place int, id bigint, vec array<double>")


def _best(queries: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, rows: np.ndarray, ids: np.ndarray,
          top: int) -> tuple[list, list, list]:
    """The ``top`` ids of each query in one group, each at its best row, by
    exact score and id, as far as they reach its floor."""
    out_q, out_v, out_s = [], [], []
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])    # first row of each id
    repeated = len(starts) < len(ids)
    queries, rows = _scaled(queries), _scaled(rows)
    q_norm, r_norm = (np.sqrt((x * x).sum(axis=1)) for x in (queries, rows))
    rough = (queries / q_norm[:, None]) @ (rows / r_norm[:, None]).T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    for i in range(len(queries)):
        r = rough[i]
        near = np.flatnonzero(r >= floors[i] - NEAR)
        if len(near) > top:
            best = np.maximum.reduceat(r, starts) if repeated else r[near]
            if len(best) > top:
                near = near[r[near] >= np.partition(best, -top)[-top] - NEAR]
        exact = (queries[i] * rows[near]).sum(axis=1) / (q_norm[i] * r_norm[near])
        order = np.lexsort((ids[near], -exact))
        if repeated:
            order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])]
        order = order[:top]
        order = order[exact[order] >= floors[i]]
        out_q += [q_ids[i]] * len(order)
        out_v += ids[near][order].tolist()
        out_s += exact[order].tolist()
    return out_q, out_v, out_s


def search(vecs: DataFrame, queries: DataFrame, top: int = TOP, *, ratio: float | None = None, boundary: float | None = None,
           sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` rows of ``vecs`` nearest to
    each row of ``queries`` (both ``vec_id``, ``vec``), other ids only.
    ``ratio`` and ``boundary`` replace the tuned ones."""
    spark = vecs.sparkSession
    vecs = materialize_table(vecs.dropDuplicates(["vec_id", "vec"]), "vectors")
    queries = materialize_table(queries.dropDuplicates(["vec_id", "vec"]), "queries")
    centroids = fit(vecs, sample_rows, list_rows, top)
    if centroids is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    ratio = centroids.ratio if ratio is None else ratio
    boundary = centroids.boundary if boundary is None else boundary
    index = spark.sparkContext.broadcast(centroids)
    posted = materialize_table(_route(vecs, index, lambda c, x: c.lists(x, boundary)), "postings")
    probes = materialize_table(_route(queries, index, lambda c, x: [c.search(q, ratio) for q in x]), "probes")

    # a row a list: into how many blocks its vectors and its queries fall
    sizes = materialize_table(posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / VECTOR_BLOCK).cast("int").alias("nv")), "sizes")

    def blocks_for(probes: DataFrame) -> DataFrame:
        asked = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("nq"))
        return F.broadcast(materialize_table(sizes.join(asked, "list"), "lists"))

    def dealt(df: DataFrame, blocks: DataFrame, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
        df = df.join(blocks, "list").withColumn(own, F.pmod(F.xxhash64("id"), F.col(n_own)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("nv", "nq", "place")

    def scan(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, v, s = _best(np.stack(asked["vec"].to_numpy()), asked["id"].to_numpy(), asked["floor"].to_numpy(),
                        np.stack(rows["vec"].to_numpy()), rows["id"].to_numpy(), top)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    key = ["list", "vb", "qb"]

    def scanned(asked: DataFrame, blocks: DataFrame) -> DataFrame:
        left, right = dealt(posted, blocks, "vb", "qb", "nv", "nq"), dealt(asked, blocks, "qb", "vb", "nq", "nv")
        near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(scan, "query_id bigint, vec_id bigint, score double")
        return near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(near: DataFrame) -> DataFrame:
        return near.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)

    def merged(near: DataFrame, found: DataFrame) -> DataFrame:
        near = near.unionByName(found.drop("rank")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return ranked(near)

    blocks = blocks_for(probes)
    first = materialize_table(ranked(scanned(probes.where("place = 0").withColumn("floor", F.lit(-2.0)), blocks)), "nearest")
    floors = first.where(F.col("rank") == top).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    rest = probes.where("place > 0").join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    found = materialize_table(merged(scanned(rest, blocks), first), "found")

    # queries short of results go to the next nearest lists, if there are more
    start, stop, n_lists = 0, FIRST_LISTS, len(centroids.c)
    while 1 < n_lists and start < n_lists:
        full = found.where(F.col("rank") == top).select(F.col("query_id").alias("vec_id"))
        short = materialize_table(queries.join(full, "vec_id", "left_anti"), "short")
        if short.isEmpty():
            break
        step = max(1, min(ROUTE_BLOCK, ROUTE_ROWS // (min(stop, n_lists) - start)))
        wider = materialize_table(_route(short, index, lambda c, x, a=start, b=stop: c.nearest(x, a, b), step), "wider")
        asked = wider.withColumn("floor", F.lit(-2.0))
        found = materialize_table(merged(scanned(asked, blocks_for(wider)), found), "found")
        start, stop = stop, stop * WIDEN
    return found.select("query_id", "rank", "vec_id", "score")
