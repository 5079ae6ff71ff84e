"""Exact per-feature tree attributions for the boosted-tree churn model
(F12-F14), as a distributed job.

For one tree, the path-dependent value of a feature subset S is
``v(S) = sum over leaves L of value(L) * prod over features f on L's path of
(o_f(x) if f in S else z_f)``, where ``o_f`` is 1 when the row satisfies every
test on f along the path and ``z_f`` is the product of the child/parent
cover ratios of those tests.  Each leaf term is a product game, whose
Shapley values are

    phi_f = (o_f - z_f) * integral over t from 0 to 1 of
            prod_{j != f} ((1 - t) z_j + t o_j)

(j over the features on the path).  The integrand is a polynomial of a degree
below the number of features on the path, so a Gauss-Legendre rule of half as
many points gives it exactly.  One walk of a tree carries the product at those
points for all rows of a batch: an edge multiplies its feature's factor in (and
takes out the factor of an earlier edge of the same feature), and the sums that
come back from below an edge, divided by its factor, are all its feature needs.
So each edge is visited once, however many leaves lie below it.  Per row, the
attributions plus the expected value add up to the model margin.

What a row adds to them below a node depends only on the outcomes of the tests
above and below that node.  So a tree is cut into parts of at most ``MOST_TESTS``
such tests, the walk is made once for every pattern of outcomes, and a row looks
its pattern up: one addition a part and feature.  Trees whose paths have more
tests are walked for the rows themselves.

The model (at most trees x nodes rows) is shipped with the function; the rows
are processed by ``mapInArrow`` in Arrow batches, so the work is spread over
all tasks.  Cover is the node's weighted training count (its hessian in
second-order trees).  Attributions are in margin units (MLlib's probability is
``1 / (1 + exp(-2 * margin))``)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlytics.operators.boosting import BoostedTrees
from custlytics.operators.rank import exact_quantiles
from custlytics.schemas import FEATURES
from custlytics.session import scratch_path, track


@dataclass
class Node:
    """A leaf (``feature`` -1), or a test that sends ``x <= limit`` left."""
    share: float                      # cover / cover of the parent
    value: float = 0.0                # of a leaf, with the tree's weight
    feature: int = -1
    limit: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def depth(self) -> int:
        return 0 if self.feature < 0 else 1 + max(self.left.depth(), self.right.depth())

    def expected(self) -> float:
        """Mean value of the leaves below, by cover."""
        if self.feature < 0:
            return self.value
        return sum(child.share * child.expected() for child in (self.left, self.right))


def gbt_trees(gbt_model, spark=None) -> list[Node]:
    """Trees of a fitted GBT (classification or regression) model, read from
    the node table of its saved form (bounded by trees x nodes)."""
    if spark is None:
        from pyspark.sql import SparkSession
        spark = SparkSession.active()
    path = scratch_path(spark, "gbt-nodes")
    track(spark, path)
    gbt_model.write().overwrite().save(path)
    trees: dict[int, dict[int, object]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r

    def built(nodes, k, weight, share) -> Node:
        r = nodes[k]
        if r["leftChild"] < 0:
            return Node(share, weight * r["prediction"])
        cover = float(r["impurityStats"][0]) or 1.0
        left, right = (built(nodes, c, weight, float(nodes[c]["impurityStats"][0]) / cover)
                       for c in (r["leftChild"], r["rightChild"]))
        return Node(share, 0.0, r["split"]["featureIndex"], float(r["split"]["leftCategoriesOrThreshold"][0]), left, right)

    weights = list(gbt_model.treeWeights)
    return [built(nodes, 0, weights[t], 1.0) for t, nodes in sorted(trees.items())]


def boosted_trees(model: BoostedTrees) -> list[Node]:
    """The same of second-order trees; cover is a node's hessian."""
    trees: dict[int, dict[int, tuple]] = {}
    for t, k, f, limit, value, cover in model.nodes():
        trees.setdefault(t, {})[k] = (f, limit, value, cover)

    def built(nodes, k, share) -> Node:
        f, limit, value, cover = nodes[k]
        if f < 0:
            return Node(share, value)
        left, right = (built(nodes, c, nodes[c][3] / cover) for c in (2 * k + 1, 2 * k + 2))
        return Node(share, 0.0, f, limit, left, right)

    return [built(nodes, 0, 1.0) for _, nodes in sorted(trees.items())]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b; 0 where b is 0 (a is 0 there as well: it has b as a factor)."""
    return np.divide(a, b, out=np.zeros(np.broadcast_shapes(a.shape, b.shape)), where=b != 0)


def _add_tree(phi: np.ndarray, x: np.ndarray, root: Node) -> None:
    """Add a tree's attributions to ``phi`` (features x rows); ``x`` likewise."""
    _walk(phi, root, lambda node: x[node.feature] <= node.limit, x.shape[1])


def _walk(phi: np.ndarray, root: Node, left_of, rows: int, within: frozenset | None = None) -> None:
    """The walk; ``left_of`` tells which rows a node sends left.  ``within``:
    ids of the nodes to enter (None: all), for the share of the leaves there."""
    depth = root.depth()
    if depth == 0:
        return
    points, weights = np.polynomial.legendre.leggauss((min(depth, len(phi)) + 1) // 2)
    t, weights = (points[:, None] + 1) / 2, weights / 2

    def below(node: Node, product: np.ndarray, met: dict) -> np.ndarray:
        """Sum over the node's leaves of value times product (points x rows);
        ``met``: what the features so far contribute to the product."""
        f = node.feature
        if f < 0:
            return node.value * product
        goes_left, earlier, total = left_of(node), met.get(f), 0.0
        if earlier is not None:
            product = _ratio(product, earlier[2])
        for child, here in ((node.left, goes_left), (node.right, ~goes_left)):
            if within is not None and id(child) not in within:
                continue
            one, zero = here.astype(float), child.share
            if earlier is not None:
                one, zero = one * earlier[0], zero * earlier[1]
            factor = (1 - t) * zero + t * one
            part = below(child, product * factor, {**met, f: (one, zero, factor)})
            phi[f] += (one - zero) * (weights @ _ratio(part, factor))
            if earlier is not None:              # the earlier edge counts these leaves too
                phi[f] -= (earlier[0] - earlier[1]) * (weights @ _ratio(part, earlier[2]))
            total = total + part
        return total

    below(root, np.ones((len(t), rows)), {})


#: Most tests of a part of a tree: a table has 2 ** MOST_TESTS columns at most.
MOST_TESTS = 8


@dataclass
class Part:
    """The leaves below a node: places of the tests that matter to them (in the
    tree's list of tests) and, for each pattern of outcomes (bit k: the k-th
    test sends left), the attributions of ``features``."""
    tests: list[int]
    features: list[int]
    table: np.ndarray


@dataclass
class Tables:
    """A tree as its tests (feature, limit) and parts; ``root``, if it is too deep."""
    tests: list[tuple[int, float]]
    parts: list[Part]
    root: Node | None = None


def _inner(node: Node) -> list[Node]:
    return [] if node.feature < 0 else [node, *_inner(node.left), *_inner(node.right)]


def _everything(node: Node) -> list[Node]:
    return [node] if node.feature < 0 else [node, *_everything(node.left), *_everything(node.right)]


def tables(root: Node, n_features: int) -> Tables:
    """The attributions of a tree for all outcomes of its tests."""
    if root.depth() > MOST_TESTS:
        return Tables([], [], root)
    nodes = _inner(root)
    place = {id(n): i for i, n in enumerate(nodes)}
    parts: list[Part] = []

    def cut(node: Node, above: list[Node]) -> None:
        mine = above + _inner(node)
        if len(mine) > MOST_TESTS:
            cut(node.left, [*above, node])
            cut(node.right, [*above, node])
            return
        patterns = np.arange(1 << len(mine))
        bit = {id(n): (patterns >> k & 1).astype(bool) for k, n in enumerate(mine)}
        phi = np.zeros((n_features, len(patterns)))
        _walk(phi, root, lambda n: bit[id(n)], len(patterns), frozenset(id(n) for n in [*above, *_everything(node)]))
        some = sorted({n.feature for n in mine})
        parts.append(Part([place[id(n)] for n in mine], some, np.ascontiguousarray(phi[some])))

    if nodes:
        cut(root, [])
    return Tables([(n.feature, n.limit) for n in nodes], parts)


def add_tables(phi: np.ndarray, x: np.ndarray, tree: Tables) -> None:
    """Add a tree's attributions to ``phi`` (features x rows); ``x`` likewise."""
    if tree.root is not None:
        _add_tree(phi, x, tree.root)
        return
    left = [(x[f] <= limit).view(np.uint8) for f, limit in tree.tests]
    for part in tree.parts:
        pattern = np.zeros(x.shape[1], np.uint8 if len(part.tests) <= 8 else np.int64)
        for k, test in enumerate(part.tests):
            pattern |= left[test] << k
        pattern = pattern.astype(np.intp)
        for f, values in zip(part.features, part.table, strict=True):
            phi[f] += values[pattern]


#: Rows worked on at once: what a tree needs of them stays in the cache.
ROWS = 4_096


def attributions_matrix(x: np.ndarray, trees: Sequence[Node | Tables], n_features: int) -> np.ndarray:
    """phi (rows x features) for a batch of feature rows."""
    phi = np.zeros((n_features, len(x)))
    trees = [tables(t, n_features) if isinstance(t, Node) else t for t in trees]
    for at in range(0, len(x), ROWS):
        part, columns = np.zeros((n_features, len(x[at:at + ROWS]))), np.ascontiguousarray(x[at:at + ROWS].T)
        for tree in trees:
            add_tables(part, columns, tree)
        phi[:, at:at + ROWS] = part
    return phi.T


def tree_attributions(model, df: DataFrame, features: Sequence[str] = FEATURES,
                      id_col: str = "customer_id") -> DataFrame:
    """long table (id, feature, value, attribution) for every row of
    ``df``.  ``model`` holds second-order trees, or is a fitted PipelineModel
    whose last stage is the GBT (or the GBT model itself)."""
    if isinstance(model, BoostedTrees):
        trees = boosted_trees(model)
    else:
        trees = gbt_trees(model.stages[-1] if hasattr(model, "stages") else model, df.sparkSession)
    expected = sum(root.expected() for root in trees)
    feats, parts = list(features), [tables(root, len(features)) for root in trees]
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, feature string, value double, attribution double, expected_value double"

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(feats))], 1)
            phi = attributions_matrix(x, parts, len(feats))
            names = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(len(feats), dtype=np.int32), n)), pa.array(feats, pa.string()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(n), len(feats)))), names.cast(pa.string()), pa.array(x.reshape(-1)),
                pa.array(np.ascontiguousarray(phi).reshape(-1)), pa.array(np.full(n * len(feats), expected))],
                names=[id_col, "feature", "value", "attribution", "expected_value"])

    src = df.select(id_col, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats])
    return src.mapInArrow(run, schema)


def attribution_importance(attr: DataFrame) -> DataFrame:
    """mean |attribution| per feature, largest first (bar-plot data)."""
    return (attr.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs_attribution"))
            .orderBy(F.desc("mean_abs_attribution"), F.asc("feature")))


def attribution_summary(attr: DataFrame) -> DataFrame:
    """per feature the spread of attributions (exact 5/50/95 % points)
    and how they move with the feature value (correlation) -- the data of a
    summary plot."""
    stats = attr.groupBy("feature").agg(
        F.avg("attribution").alias("mean_attribution"),
        F.avg(F.abs("attribution")).alias("mean_abs_attribution"),
        F.min("attribution").alias("min_attribution"), F.max("attribution").alias("max_attribution"),
        # Pearson correlation; null (not an ANSI error) for a constant column
        F.try_divide(F.covar_samp("value", "attribution"),
                     F.stddev_samp("value") * F.stddev_samp("attribution")).alias("value_correlation"))
    qs = exact_quantiles(attr, "attribution", (0.05, 0.5, 0.95), by=["feature"])
    qs = qs.select("feature", F.col("q0").alias("p05"), F.col("q1").alias("p50"), F.col("q2").alias("p95"))
    # one row per feature on both sides
    return stats.join(F.broadcast(qs), "feature").orderBy(F.desc("mean_abs_attribution"), F.asc("feature"))
