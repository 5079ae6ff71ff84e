"""Second-order boosted trees, many models at once.

Features are binned once, at quantile edges, into one byte each, and rows are
packed into blocks of one fold, a column after the other, so that tasks work on
whole columns and a model passes over the blocks that it leaves out.  A pass is
one Spark job that serves every model being grown -- all (setting, fold)
candidates of a search and their refits: tasks add each row's gradient and
hessian to the histograms of the model's current level, histograms are summed
by model after a shuffle of one small array a (task, model), and the best split
of every node comes back, a row a model.  The number of passes is that of the
deepest model's levels, however many models there are; rows never move.

Every pass starts a job and finds each row's margin and node anew.  Where the
binned rows fit in a task's memory (``WHOLE_BYTES``, checked against their
count) one job deals them to the models instead, and each task grows one model,
all levels and trees, to the same sums; of two sister nodes the one of fewer
rows is counted and the other is what is left of their parent.

Gradients are added as integers (multiples of 2^-24), so sums and trees do not
depend on the order or number of tasks, and a task run again after a lost
executor adds the same.  Margins of finished trees are stored with the binned
rows every ``KEEP_EVERY`` trees; the trees since then are walked again.

Learning follows the usual form: logistic loss, leaf value -G / (H + lambda),
gain from (G, H) of both sides, at least ``MIN_CHILD`` hessian a child, rows and
features sampled per tree by hashes of the seed."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlytics.session import drop_scratch, scratch_path, track

BINS = 64
#: L2 penalty on leaf values, smallest hessian of a child.
LAMBDA, MIN_CHILD = 1.0, 1.0
#: Trees between two writes of the margins.
KEEP_EVERY = 10
#: Rows of a block, and of a task.
BLOCK_ROWS, TASK_ROWS = 16_384, 262_144
UNIT = float(1 << 24)
#: Bytes of binned rows up to which a task grows a whole model (it then holds some three times as much), and of a row beside its bins.
WHOLE_BYTES, ROW_BYTES = 256 << 20, 20


@dataclass(frozen=True)
class Setting:
    """One model to grow; rows of ``fold`` are left out (None: of no fold)."""
    n_estimators: int = 100
    max_depth: int = 4
    learning_rate: float = 0.1
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    fold: int | None = None
    seed: int = 42


@dataclass
class Trees:
    """Complete binary trees as arrays (tree, node): feature (-1: leaf), bin
    (a row goes left if its bin is not larger), value of the leaf, hessian."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @staticmethod
    def empty(depth: int) -> Trees:
        shape = (0, 2 ** (depth + 1) - 1)
        return Trees(np.zeros(shape, np.int16), np.zeros(shape, np.int16), np.zeros(shape), np.zeros(shape))

    def joined(self, tree: Trees) -> Trees:
        return Trees(*[np.concatenate([a, b]) for a, b in zip(self.arrays(), tree.arrays(), strict=True)])

    def arrays(self):
        return self.feature, self.cut, self.value, self.cover

    def since(self, at: int) -> Trees:
        return Trees(*[a[at:] for a in self.arrays()])


#: Trees up to this depth are walked all nodes at once, deeper ones node by node.
FLAT_DEPTH = 6


def ends(feature: np.ndarray, cut: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The node at which each row of bins (features, rows) stops.  All tests are
    made first; level by level from below, a test then takes one of two ends."""
    split, n = np.flatnonzero(feature >= 0), columns.shape[1]
    if not len(split):
        return np.zeros(n, np.uint8)
    depth = int(split[-1] + 1).bit_length()
    inner = (1 << depth) - 1
    if depth > FLAT_DEPTH:
        node, at = np.zeros(n, np.int64), np.arange(n)
        for _ in range(depth):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (columns[np.maximum(f, 0), at] > cut[node]), node)
        return node
    stop = np.arange(2 * inner + 1, dtype=np.uint8)
    for k in range(inner):
        if feature[k] < 0 or stop[k] != k:                   # stopped here or above
            stop[2 * k + 1:2 * k + 3] = stop[k]
    right = -(columns[np.maximum(feature[:inner], 0)] > cut[:inner, None].astype(np.uint8)).view(np.uint8)
    end = stop[inner:, None]
    for level in reversed(range(depth)):
        left = end[0::2]
        end = left ^ ((left ^ end[1::2]) & right[(1 << level) - 1:(2 << level) - 1])
    return end[0]


def walk(trees: Trees, bins: np.ndarray) -> np.ndarray:
    """Sum of the leaf values that rows of bins (rows, features) reach; columns
    lie together."""
    total, columns = np.zeros(len(bins)), bins.T
    for feature, cut, value in zip(trees.feature, trees.cut, trees.value, strict=True):
        total += value[ends(feature, cut, columns)]
    return total


# ------------------------------------------------------------------ binning

def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Ascending edges of each feature, from approximate quantiles: one
    aggregate, one row."""
    shares = ", ".join(f"{i / bins}D" for i in range(1, bins))
    row = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]).agg(
        *[F.expr(f"percentile_approx(f{i}, array({shares}), {100 * bins})") for i in range(len(features))]).first()
    return [np.unique(np.array([x for x in r or [] if not math.isnan(x)], float)) for r in row]


def to_bins(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins (rows, features), stored by column."""
    return np.stack([np.searchsorted(e, c, side="left").astype(np.uint8) for e, c in zip(edges, columns, strict=True)]).T


STATE = T.StructType([
    T.StructField("id_hash", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("fold", T.IntegerType()),
    T.StructField("weight", T.DoubleType()), T.StructField("bins", T.BinaryType()), T.StructField("margins", T.BinaryType())])
#: A block of rows of one fold: the rows' values one after the other; bins by feature, margins by model.
BLOCK = T.StructType([T.StructField("rows", T.IntegerType()), T.StructField("fold", T.IntegerType()), *[
    T.StructField(c, T.BinaryType()) for c in ("id_hash", "label", "weight", "bins", "margins")]])


def _blocks(train: DataFrame, features, label, id_col, weight: Column, edges, models: int) -> DataFrame:
    rows = train.select(F.xxhash64(F.col(id_col).cast("string")).alias("id_hash"), F.col(label).cast("int"), F.col("fold").cast("int"),
                        weight.cast("double").alias("weight"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int | None, list[_Rows]] = {}
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in (batch.column(i) for i in (0, 1, 3))]
            bins = to_bins([batch.column(4 + i).to_numpy(zero_copy_only=False) for i in range(len(edges))], edges).T
            folds = batch.column(2)
            for fold in folds.unique().to_pylist():
                mine = folds.is_null() if fold is None else pc.equal(folds, fold).fill_null(False)
                at = np.flatnonzero(mine.to_numpy(zero_copy_only=False))
                for some in np.array_split(at, -(-len(at) // BLOCK_ROWS)):
                    held = waiting.setdefault(fold, [])
                    if sum(len(x.key) for x in held) + len(some) > BLOCK_ROWS:
                        yield _Rows.joined(held).batch()
                        held.clear()
                    held.append(_Rows(columns[0][some], columns[1][some].astype(np.int32), fold, columns[2][some], bins[:, some],
                                      np.zeros((models, len(some)))))
        for held in waiting.values():
            yield _Rows.joined(held).batch()

    spark, n = train.sparkSession, train.count()
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))).mapInArrow(run, BLOCK)


@dataclass
class _Rows:
    """A block as arrays: bins are (features, rows), margins (models, rows)."""
    key: np.ndarray
    label: np.ndarray
    fold: int | None
    weight: np.ndarray
    bins: np.ndarray
    margins: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, features: int, models: int) -> Iterator[_Rows]:
        for i in range(batch.num_rows):
            key, label, weight, bins, margins = (np.frombuffer(batch.column(2 + j)[i].as_buffer(), t) for j, t in enumerate(
                (np.int64, np.int32, np.float64, np.uint8, np.float64)))
            n = len(label)
            margins = margins.reshape(models, n) if len(margins) else np.zeros((models, n))   # not written while all are 0
            yield _Rows(key, label, batch.column(1)[i].as_py(), weight, bins.reshape(features, n), margins)

    @staticmethod
    def joined(parts: Sequence[_Rows]) -> _Rows:
        def whole(name):
            return np.concatenate([getattr(p, name) for p in parts], -1)
        return _Rows(whole("key"), whole("label"), parts[0].fold, whole("weight"), whole("bins"), whole("margins"))

    def batch(self) -> pa.RecordBatch:
        """The block as one row."""
        return pa.RecordBatch.from_arrays([pa.array([len(self.key)], pa.int32()), pa.array([self.fold], pa.int32()), *[
            pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (self.key, self.label, self.weight, self.bins, self.margins)]],
            names=BLOCK.fieldNames())

    def rows(self) -> pa.RecordBatch:
        """A row for each of its rows."""
        n = len(self.key)

        def each(v):                                         # a row's bytes lie together
            raw = np.ascontiguousarray(v.T)
            return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (raw.nbytes // max(1, n))), pa.py_buffer(raw)])
        return pa.RecordBatch.from_arrays([pa.array(self.key), pa.array(self.label), pa.array([self.fold] * n, pa.int32()), pa.array(self.weight),
                                           each(self.bins), each(self.margins)], names=STATE.fieldNames())


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit integers."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ------------------------------------------------------------------ growing

@dataclass
class _Growing:
    """A model and where it stands: trees done, the one under way and its level."""
    setting: Setting
    number: int
    trees: Trees
    kept: int = 0                                            # trees whose margins are stored
    level: int = 0
    tree: Trees | None = None
    open: set = field(default_factory=lambda: {0})           # nodes of the level that may split

    def done(self) -> bool:
        return len(self.trees.feature) >= self.setting.n_estimators

    def sample_seed(self) -> int:
        """What the rows of the tree under way are sampled by."""
        return self.setting.seed * 1_000_003 + len(self.trees.feature)

    def features(self, n: int) -> np.ndarray:
        """The features that the tree under way may use."""
        take = max(1, int(self.setting.colsample_bytree * n))
        rng = np.random.default_rng([self.setting.seed, len(self.trees.feature)])
        return np.sort(rng.permutation(n)[:take])


def _task(g: _Growing, n_features: int) -> dict:
    """What a task must know of a model, and nothing of the session."""
    return {"number": g.number, "fold": g.setting.fold, "share": g.setting.subsample, "seed": g.sample_seed(),
            "recent": g.trees.since(g.kept), "tree": g.tree, "level": g.level, "features": g.features(n_features)}


def _gradients(rows: _Rows, margin: np.ndarray, share: float, seed: int, at: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Integer gradients and hessians of the rows ``at``, which have the
    margins; 0 for those left out of the sample."""
    p, w = 1.0 / (1.0 + np.exp(-margin)), rows.weight[at]
    if share < 1.0:
        w = w * ((_mixed(rows.key[at].view(np.uint64) ^ _mixed(np.array([seed]))[0]) >> np.uint64(11)).astype(float) < share * 2.0 ** 53)
    return np.rint(w * (p - rows.label[at]) * UNIT), np.rint(w * p * (1.0 - p) * UNIT)


def _histograms(rows: _Rows, m: dict, bins: int, places: Sequence[np.ndarray]) -> np.ndarray:
    """(2, nodes, features, bins) integer gradients and hessians of a level;
    ``places`` are the bins as indices."""
    nodes, some = 1 << m["level"], m["features"]
    g, h = _gradients(rows, rows.margins[m["number"]] + walk(m["recent"], rows.bins.T), m["share"], m["seed"])
    first = None
    if m["level"]:                                           # rows that stopped at a leaf above go past the last node
        node = ends(m["tree"].feature[0], m["tree"].cut[0], rows.bins).astype(np.int64) - (nodes - 1)
        first = np.where(node >= 0, node, nodes) * bins
    out = np.empty((2, nodes, len(some), bins), np.int64)
    for i, f in enumerate(some):
        cell = places[f] if first is None else places[f] + first
        for k, v in enumerate((g, h)):
            out[k, :, i] = np.rint(np.bincount(cell, v, (nodes + 1) * bins)[:nodes * bins]).reshape(nodes, bins)
    return out


def _best_splits(hist: np.ndarray) -> np.ndarray:
    """For each node (place of the feature or -1, bin, G, H, left G, left H):
    the largest gain, ties to the first feature and bin."""
    g, h = (np.cumsum(x, -1) / UNIT for x in hist)
    total_g, total_h = g[:, :1, -1:], h[:, :1, -1:]
    right_g, right_h = total_g - g, total_h - h
    gain = g ** 2 / (h + LAMBDA) + right_g ** 2 / (right_h + LAMBDA) - total_g ** 2 / (total_h + LAMBDA)
    gain = np.where((h >= MIN_CHILD) & (right_h >= MIN_CHILD), gain, -np.inf)
    nodes, _, bins = gain.shape
    best = gain.reshape(nodes, -1).argmax(1)
    at = np.arange(nodes)
    f, b = best // bins, best % bins
    f = np.where(gain[at, f, b] > 1e-6, f, -1)
    return np.stack([f, b, total_g[:, 0, 0], total_h[:, 0, 0], g[at, best // bins, b], h[at, best // bins, b]], 1)


def _pass(state: DataFrame, growing: list[_Growing], n_features: int, n_models: int, bins: int) -> dict[int, np.ndarray]:
    """The best splits of the current level of every growing model."""
    tasks = [_task(g, n_features) for g in growing]
    shapes = {m["number"]: (2, 1 << m["level"], len(m["features"]), bins) for m in tasks}
    schema = T.StructType([T.StructField("model", T.IntegerType()), T.StructField("sums", T.BinaryType())])

    def rows_of(totals: Mapping[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())],
                                          names=schema.fieldNames())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows in _Rows.of(batch, n_features, n_models):
                places = rows.bins.astype(np.int64)
                for m in tasks:
                    if m["fold"] is None or m["fold"] != rows.fold:
                        part = _histograms(rows, m, bins, places)
                        totals[m["number"]] = totals[m["number"]] + part if m["number"] in totals else part
        if totals:
            yield rows_of(totals)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(sums, np.int64).reshape(shapes[number])
                totals[number] = totals[number] + part if number in totals else part
        if totals:
            yield rows_of({k: _best_splits(v) for k, v in totals.items()})

    n = min(len(tasks), state.sparkSession.sparkContext.defaultParallelism, max(1, int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = state.mapInArrow(add, schema).repartition(n, "model").mapInArrow(split, schema).collect()
    return {r["model"]: np.frombuffer(r["sums"], float).reshape(-1, 6) for r in found}


def _advance(g: _Growing, splits: np.ndarray, n_features: int) -> None:
    """One level further: nodes split or become leaves, then maybe the next tree."""
    size, some = 2 ** (g.setting.max_depth + 1) - 1, g.features(n_features)
    if g.tree is None:
        g.tree = Trees(np.full((1, size), -1, np.int16), np.zeros((1, size), np.int16), np.zeros((1, size)), np.zeros((1, size)))
    first, rate, following = (1 << g.level) - 1, g.setting.learning_rate, set()
    for k in sorted(g.open):
        f, b, total_g, total_h, left_g, left_h = splits[k - first]
        if k == 0:
            g.tree.value[0, 0], g.tree.cover[0, 0] = -rate * total_g / (total_h + LAMBDA), total_h
        if f < 0:
            continue
        g.tree.feature[0, k], g.tree.cut[0, k] = some[int(f)], int(b)
        for child, (cg, ch) in ((2 * k + 1, (left_g, left_h)), (2 * k + 2, (total_g - left_g, total_h - left_h))):
            g.tree.value[0, child], g.tree.cover[0, child] = -rate * cg / (ch + LAMBDA), ch
            following.add(child)
    g.level += 1
    g.open = following
    if not following or g.level >= g.setting.max_depth:
        g.trees, g.tree, g.level, g.open = g.trees.joined(g.tree), None, 0, {0}


# ------------------------------------------------- growing whole models

#: Cells in which several features are counted as one.
GROUP_CELLS = 4_096


def _groups(sizes: Sequence[int]) -> list[list[int]]:
    """Features (by place) dealt to groups with at most ``GROUP_CELLS``
    combinations of bins, or one feature: first fit, large ones first."""
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [g for g in out if math.prod(sizes[j] for j in g) * sizes[i] <= GROUP_CELLS]
        if fits:
            fits[0].append(i)
        else:
            out.append([i])
    return out


def _steps(n: int, step: int) -> Iterator[slice]:
    return (slice(a, a + step) for a in range(0, n, step))


class _Counts:
    """Sums over the rows of a node: one tree's features and gradients."""

    def __init__(self, columns: Sequence[np.ndarray], sizes: Sequence[int], sums_of: Sequence[np.ndarray], bins: int, step: int):
        self.columns, self.sizes, self.sums_of, self.bins, self.step = columns, sizes, sums_of, bins, step
        self.groups, self.cells = _groups(sizes), []
        for group in self.groups:
            cell = columns[group[0]].astype(np.uint16)
            for i in group[1:]:
                cell *= np.uint16(sizes[i])
                cell += columns[i]
            self.cells.append(cell)

    def of(self, at: np.ndarray) -> np.ndarray:
        """(2, features, bins) integer gradients and hessians of the rows ``at``."""
        return (self._few if len(at) < 4 * GROUP_CELLS else self._many)(at)

    def _few(self, at: np.ndarray) -> np.ndarray:
        n, bins = len(self.columns), self.bins
        out, first = np.zeros((2, n * bins), np.int64), np.arange(0, n * bins, bins)[:, None]
        for s in _steps(len(at), self.step):
            some = at[s]
            cell = (np.stack([c[some] for c in self.columns]) + first).ravel()
            for k, v in enumerate(self.sums_of):
                out[k] += np.bincount(cell, np.tile(v[some], n), n * bins).astype(np.int64)
        return out.reshape(2, n, bins)

    def _many(self, at: np.ndarray) -> np.ndarray:
        sums = [np.zeros((2, math.prod(self.sizes[i] for i in g)), np.int64) for g in self.groups]
        for s in _steps(len(at), self.step):
            some = at[s].astype(np.intp)
            values = [v[some] for v in self.sums_of]
            for cells, total in zip(self.cells, sums, strict=True):
                cell = cells[some].astype(np.intp)
                for k, v in enumerate(values):
                    total[k] += np.bincount(cell, v, total.shape[1]).astype(np.int64)
        out = np.zeros((2, len(self.columns), self.bins), np.int64)
        for group, total in zip(self.groups, sums, strict=True):
            total = total.reshape(2, *[self.sizes[i] for i in group])
            for axis, i in enumerate(group, 1):
                out[:, i, :self.sizes[i]] = total.sum(tuple(a for a in range(1, len(group) + 1) if a != axis))
        return out


def _grown(rows: _Rows, setting: Setting, bins: int) -> Trees:
    """The trees of a model from all its rows."""
    n, g, margin = len(rows.bins), _Growing(setting, 0, Trees.empty(setting.max_depth)), np.zeros(len(rows.label))
    sums_of = np.empty((2, len(margin)))
    sizes = [int(b.max(initial=0)) + 1 for b in rows.bins]
    # sums of a step stay below 2^53, where doubles count exactly
    step = max(1, min(4 * BLOCK_ROWS, int(2.0 ** 28 / max(1.0, np.abs(rows.weight).max(initial=0.0)))))
    while not g.done():
        for s in _steps(len(margin), BLOCK_ROWS):
            sums_of[:, s] = _gradients(rows, margin[s], setting.subsample, g.sample_seed(), s)
        some, before = g.features(n), len(g.trees.feature)
        counts = _Counts([rows.bins[f] for f in some], [sizes[f] for f in some], sums_of, bins, step)
        at = {0: np.flatnonzero((sums_of[0] != 0) | (sums_of[1] != 0)).astype(np.int32)}   # a whole table's rows are few
        sums = {0: counts.of(at[0])}
        while True:
            first = (1 << g.level) - 1
            hist = np.zeros((2, first + 1, len(some), bins), np.int64)
            for k in g.open:
                hist[:, k - first] = sums[k]
            _advance(g, _best_splits(hist), n)
            if len(g.trees.feature) > before:
                break
            parents, sums = sums, {}
            for left in sorted(g.open)[::2]:                 # both children of a node or none
                k = (left - 1) // 2
                mine, column, cut = at.pop(k), rows.bins[g.tree.feature[0, k]], g.tree.cut[0, k]
                right = np.empty(len(mine), bool)
                for s in _steps(len(mine), step):
                    right[s] = column[mine[s]] > cut
                at[left + 1] = mine.compress(right)
                at[left] = mine.compress(np.logical_not(right, right))
                few, many = (left, left + 1) if len(at[left]) <= len(at[left + 1]) else (left + 1, left)
                sums[few] = counts.of(at[few])
                sums[many] = parents[k] - sums[few]
        last = g.trees.since(before)
        for s in _steps(len(margin), BLOCK_ROWS):
            margin[s] += walk(last, rows.bins[:, s].T)
    return g.trees


def _grow_whole(held: DataFrame, growing: Sequence[_Growing], n_features: int, bins: int) -> None:
    """All trees of all models in one job, a task a model, the longest first."""
    spark, settings = held.sparkSession, [g.setting for g in growing]
    work = sorted(range(len(settings)), key=lambda i: (settings[i].fold is not None, -settings[i].n_estimators * settings[i].max_depth))
    models = spark.createDataFrame([(i, slot, settings[i].fold, settings[i].subsample < 1.0) for slot, i in enumerate(work)],
                                   "model int, slot int, left_out int, samples boolean")
    # a row a model: broadcast by construction; ids go along where rows are sampled by them
    dealt = held.join(F.broadcast(models), F.col("left_out").isNull() | ~F.col("fold").eqNullSafe(F.col("left_out"))).withColumn(
        "id_hash", F.when(F.col("samples"), F.col("id_hash")).otherwise(F.lit(b""))).drop("left_out", "samples")
    schema = T.StructType([T.StructField("model", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("feature", "cut", "value", "cover")]])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[_Rows]] = {}
        for batch in batches:
            for number, rows in zip(batch.column(batch.schema.get_field_index("model")).to_pylist(), _Rows.of(batch, n_features, 0), strict=True):
                parts.setdefault(number, []).append(rows)
        batch = rows = None                                  # parts are let go once joined
        for number in list(parts):
            trees = _grown(_Rows.joined(parts.pop(number)), settings[number], bins)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in trees.arrays()]],
                                             names=schema.fieldNames())

    for r in dealt.repartitionById(len(settings), "slot").mapInArrow(grow, schema).collect():   # a row a model
        width = growing[r["model"]].trees.feature.shape[1]
        growing[r["model"]].trees = Trees(*[np.frombuffer(r[1 + i], t).reshape(-1, width) for i, t in enumerate((np.int16, np.int16, float, float))])


def _stored(state: DataFrame) -> tuple[DataFrame, str]:
    """The state written to the scratch folder and read from there, and its path."""
    path = scratch_path(state.sparkSession, "boosting-state")
    state.write.parquet(path)
    track(state.sparkSession, path)
    return state.sparkSession.read.schema(state.schema).parquet(path), path


def _grow_by_levels(held: DataFrame, path: str, growing: list[_Growing], n_features: int, bins: int) -> DataFrame:
    """All models side by side, a pass a level; the stored rows' margins.  The
    blocks and each state go when the next is stored: one is on disk."""
    spark, n_models = held.sparkSession, len(growing)
    held = held.persist()

    def keep(last: bool) -> tuple[DataFrame, str]:
        out = _stored(_keep(held, growing, n_features, n_models, last))
        held.unpersist()
        drop_scratch(spark, path)
        return out

    while todo := [g for g in growing if not g.done()]:
        splits = _pass(held, todo, n_features, n_models, bins)
        if not splits:                                       # no rows: no trees
            break
        for g in todo:
            _advance(g, splits[g.number], n_features)
        if max(len(g.trees.feature) - g.kept for g in growing) >= KEEP_EVERY:
            held, path = keep(last=False)
            held = held.persist()
    return keep(last=True)[0]


def _keep(state: DataFrame, growing: list[_Growing], n_features: int, n_models: int, last: bool = False) -> DataFrame:
    """The state with the margins of all finished trees; the ``last`` by row."""
    todo = [(g.number, g.trees.since(g.kept)) for g in growing if len(g.trees.feature) > g.kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _Rows.of(batch, n_features, n_models):
                rows.margins = rows.margins.copy()
                for number, trees in todo:
                    rows.margins[number] += walk(trees, rows.bins.T)
                yield rows.rows() if last else rows.batch()

    out = state.mapInArrow(run, STATE if last else BLOCK)
    for g in growing:
        g.kept = len(g.trees.feature)
    return out


@dataclass
class BoostedTrees:
    """A fitted model: trees over features cut at ``edges``."""
    features: list[str]
    edges: list[np.ndarray]
    trees: Trees
    params: dict

    def margins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        return walk(self.trees, to_bins(columns, self.edges))

    def transform(self, df: DataFrame, prob_col: str = "churn_probability", prediction: str = "prediction") -> DataFrame:
        """``df`` with the positive class's probability and the predicted class."""
        @F.pandas_udf("double")
        def probability(*columns):
            import pandas as pd
            return pd.Series(1.0 / (1.0 + np.exp(-self.margins([c.to_numpy(float) for c in columns]))))

        args = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features]
        out = df.withColumn(prob_col, probability(*args))
        return out.withColumn(prediction, (F.col(prob_col) > 0.5).cast("int"))

    def nodes(self) -> list[tuple]:
        """(tree, node, feature, threshold, value, cover), nodes in use only;
        a row goes left if its feature is not above the threshold."""
        out = []
        for t in range(len(self.trees.feature)):
            todo = [0]
            while todo:
                k = todo.pop()
                f, b = int(self.trees.feature[t, k]), int(self.trees.cut[t, k])
                edges = self.edges[f] if f >= 0 else None
                limit = None if f < 0 else (float(edges[b]) if b < len(edges) else math.inf)
                out.append((t, k, f, limit, float(self.trees.value[t, k]), float(self.trees.cover[t, k])))
                if f >= 0:
                    todo += [2 * k + 2, 2 * k + 1]
        return out

    def save(self, spark: SparkSession, path: str) -> str:
        """Nodes and edges as two small Parquet tables."""
        spark.createDataFrame(self.nodes(), "tree int, node int, feature int, threshold double, value double, cover double").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/nodes")
        rows = [(i, f, [float(x) for x in e], str(self.trees.feature.shape[1]), repr(self.params)) for i, (f, e) in enumerate(zip(self.features, self.edges))]
        spark.createDataFrame(rows, "place int, feature string, edges array<double>, width string, params string").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/features")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        import ast
        meta = spark.read.parquet(f"{path}/features").orderBy("place").collect()
        rows = spark.read.parquet(f"{path}/nodes").collect()
        edges, width = [np.array(r["edges"], float) for r in meta], int(meta[0]["width"])
        n = 1 + max((r["tree"] for r in rows), default=-1)
        trees = Trees(np.full((n, width), -1, np.int16), np.zeros((n, width), np.int16), np.zeros((n, width)), np.zeros((n, width)))
        for r in rows:
            at = r["tree"], r["node"]
            trees.feature[at], trees.value[at], trees.cover[at] = r["feature"], r["value"], r["cover"]
            if r["feature"] >= 0:
                trees.cut[at] = np.searchsorted(edges[r["feature"]], r["threshold"], side="left")
        return BoostedTrees([r["feature"] for r in meta], edges, trees, ast.literal_eval(meta[0]["params"]))


def fit_many(train: DataFrame, settings: Sequence[Setting], *, features: Sequence[str], label: str, id_col: str,
             weight: Column, bins: int = BINS) -> tuple[list[BoostedTrees], DataFrame]:
    """A model for each setting, grown side by side, and the rows' margins
    under all of them (``STATE``: margins as doubles in the settings' order).
    ``train`` has a ``fold``; rows without a label take no part."""
    n, train = len(features), train.where(F.col(label).isNotNull())
    edges = bin_edges(train, features, bins)
    held, path = _stored(_blocks(train, features, label, id_col, weight, edges, 0))
    growing = [_Growing(s, i, Trees.empty(s.max_depth)) for i, s in enumerate(settings)]
    if (held.agg(F.sum("rows")).first()[0] or 0) * (n + ROW_BYTES) <= WHOLE_BYTES:
        _grow_whole(held, growing, n, bins)
        state = _keep(held, growing, n, len(settings), last=True)   # walked when read
    else:
        state = _grow_by_levels(held, path, growing, n, bins)
    return [BoostedTrees(list(features), edges, g.trees, {k: getattr(g.setting, k) for k in (
        "n_estimators", "max_depth", "learning_rate", "subsample", "colsample_bytree")}) for g in growing], state


def held_out_margins(state: DataFrame, settings: Sequence[Setting]) -> DataFrame:
    """(candidate, fold, label, margin) of each row under the models that did
    not see it: ``settings`` are candidates x folds, candidate by candidate."""
    schema = "model int, label int, margin double"
    folds = [-1 if s.fold is None else s.fold for s in settings]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, label = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False), batch.column(1)
            margins = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<f8").reshape(batch.num_rows, -1)
            for number, f in enumerate(folds):
                at = np.flatnonzero(fold == f) if f >= 0 else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int32)), label.take(pa.array(at)).cast(pa.int32()),
                                                  pa.array(margins[at, number])], names=["model", "label", "margin"])

    return state.mapInArrow(run, schema)
