"""Second-order boosted trees against a plain loop over rows and splits."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlytics.operators import attribution as A
from custlytics.operators import boosting as B
from custlytics.operators import ml as M
from custlytics.operators.attribution import boosted_trees, tree_attributions
from custlytics.session import scratch_mark, scratch_path

FEATS = ["x", "y", "z"]


def table(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x, y, z = rng.random(n), rng.integers(0, 5, n).astype(float), np.round(rng.exponential(2, n), 1)
    label = (x + y / 4 + rng.normal(0, 0.3, n) > 1.2).astype(int)
    rows = [(f"c{i}", float(a), float(b), float(c), int(t), i % 3) for i, (a, b, c, t) in enumerate(zip(x, y, z, label))]
    return spark.createDataFrame(rows, "customer_id string, x double, y double, z double, churn_label int, fold int"), np.stack([x, y, z], 1), label


def fit(df, settings, **options):
    options = {"weight": F.lit(1.0), "features": FEATS, "label": "churn_label", "id_col": "customer_id", **options}
    return B.fit_many(df, settings, **options)


def plain(x, label, edges, setting):
    """Margins after every tree, by trying every split of every node."""
    bins, margin, seen = B.to_bins(list(x.T), edges), np.zeros(len(x)), []
    for _ in range(setting.n_estimators):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - label) * B.UNIT) / B.UNIT, np.rint(p * (1 - p) * B.UNIT) / B.UNIT
        out = np.zeros(len(x))

        def grow(rows, depth):
            gs, hs = g[rows].sum(), h[rows].sum()
            best, cut = 1e-6, None
            if depth < setting.max_depth:
                for f in range(x.shape[1]):
                    for b in range(len(edges[f])):
                        left = rows[bins[rows, f] <= b]
                        lg, lh = g[left].sum(), h[left].sum()
                        if lh < B.MIN_CHILD or hs - lh < B.MIN_CHILD:
                            continue
                        gain = lg ** 2 / (lh + 1) + (gs - lg) ** 2 / (hs - lh + 1) - gs ** 2 / (hs + 1)
                        if gain > best + 1e-12:
                            best, cut = gain, (f, b)
            if cut is None:
                out[rows] = -setting.learning_rate * gs / (hs + 1)
            else:
                right = bins[rows, cut[0]] > cut[1]
                grow(rows[~right], depth + 1)
                grow(rows[right], depth + 1)

        grow(np.arange(len(x)), 0)
        margin = margin + out
        seen.append(margin)
    return seen


def test_equals_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(B, "KEEP_EVERY", 2)                  # margins stored and walked on
    df, x, label = table(spark)
    setting = B.Setting(5, 3, 0.3)
    [model], state = fit(df.repartition(5), [setting], bins=16)
    want = plain(x, label, model.edges, setting)[-1]
    assert np.allclose(model.margins(list(x.T)), want, atol=1e-9)
    kept = sorted(float(np.frombuffer(r.margins, "<f8")[0]) for r in state.collect())
    assert np.allclose(kept, sorted(want), atol=1e-9)


def test_models_grown_together_equal_models_grown_alone(spark):
    df, _, _ = table(spark)
    settings = [B.Setting(4, 2, 0.3, 0.7, 1.0, 0), B.Setting(3, 4, 0.1, 1.0, 0.7, None), B.Setting(4, 3, 0.2, 0.8, 0.4, 2)]
    together, _ = fit(df, settings)
    for setting, model in zip(settings, together, strict=True):
        [alone], _ = fit(df.repartition(3), [setting])
        for a, b in zip(model.trees.arrays(), alone.trees.arrays(), strict=True):
            assert np.array_equal(a, b)
        assert len(alone.trees.feature) == setting.n_estimators


def test_fold_is_left_out_and_scored(spark):
    df, x, _ = table(spark)
    settings = [B.Setting(3, 2, 0.3, fold=f) for f in (0, 1, 2)]
    models, state = fit(df, settings)
    other = df.withColumn("churn_label", F.when(F.col("fold") == 0, 1 - F.col("churn_label")).otherwise(F.col("churn_label")))
    changed, _ = fit(other, settings)
    assert np.array_equal(models[0].trees.value, changed[0].trees.value) and not np.array_equal(models[1].trees.value, changed[1].trees.value)
    held = B.held_out_margins(state, settings).collect()
    want = [(f, models[f].margins(list(x[np.arange(len(x)) % 3 == f].T))) for f in (0, 1, 2)]
    assert sorted((r.model, round(r.margin, 9)) for r in held) == sorted((f, round(float(m), 9)) for f, ms in want for m in ms)


def test_save_load_scores_and_attributions(spark):
    df, x, _ = table(spark)
    model = M.fit_boosted_trees(df, FEATS, n_estimators=6, max_depth=3, learning_rate=0.3, subsample=0.8, colsample_bytree=0.7)
    again = M.load_model(M.save_model(model, scratch_path(spark, "boosted-test")))
    assert np.array_equal(model.margins(list(x.T)), again.margins(list(x.T)))
    a = {r.customer_id: r.churn_probability for r in M.score(model, df).collect()}
    assert a == {r.customer_id: r.churn_probability for r in M.score(again, df).collect()}
    assert M.evaluator_auc(M.score(model, df)) > 0.85
    roots = boosted_trees(model)
    assert len(roots) == 6 and np.isfinite(sum(r.expected() for r in roots))
    per = tree_attributions(model, df, FEATS).groupBy("customer_id").agg((F.sum("attribution") + F.first("expected_value")).alias("m"))
    assert np.allclose(sorted(r.m for r in per.collect()), sorted(model.margins(list(x.T))), atol=1e-9)


def test_search_picks_the_best_draw(spark):
    df, _, _ = table(spark)
    grid = {"n_estimators": [1, 8], "max_depth": [1, 3], "learning_rate": [0.3], "subsample": [1.0], "colsample_bytree": [1.0]}
    done = M.search(df, grid, n_iter=4, features=FEATS)
    aucs = [a for _, a in done.tried]
    assert len(done.tried) == 4 and max(aucs) == done.tried[[p for p, _ in done.tried].index(done.best.params)][1]
    for i in range(4):
        again = [M.evaluator_auc(done.held_out.where(F.col("model") == 3 * i + f), "label", "margin") for f in range(3)]
        assert abs(sum(again) / 3 - aucs[i]) < 1e-5


@pytest.mark.parametrize("rows", [[], [("a", 1.0, 1.0, 1.0, 1, 0)], [("a", None, 2.0, 1.0, 1, None), ("b", 1.0, float("nan"), 1.0, None, 0)]])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "customer_id string, x double, y double, z double, churn_label int, fold int").fillna(0.0, ["x"])
    [model], state = fit(df, [B.Setting(2, 2)])
    assert state.count() == sum(r[4] is not None for r in rows)
    assert np.isfinite(model.margins([np.ones(2)] * 3)).all()


def test_one_class_and_hot_value(spark):
    df, x, _ = table(spark)
    [model], _ = fit(df.withColumn("churn_label", F.lit(1)).withColumn("x", F.lit(2.0)), [B.Setting(3, 2, 0.3)])
    assert (model.margins(list(x.T)) > 0).all()


def test_walk_tests_all_nodes_at_once():
    """Equal to a walk from node to node (deep trees too), in under half its time."""
    rng = np.random.default_rng(1)
    bins = np.asfortranarray(rng.integers(0, 64, (50_000, 12)).astype(np.uint8))

    def trees(depth, n):
        size = 2 ** (depth + 1) - 1
        feature = np.where(rng.random((n, size)) < 0.9, rng.integers(0, 12, (n, size)), -1).astype(np.int16)
        feature[:, size // 2:] = -1
        return B.Trees(feature, rng.integers(0, 63, (n, size)).astype(np.int16), rng.random((n, size)), np.ones((n, size)))

    def stepwise(t, depth):
        total, at = np.zeros(len(bins)), np.arange(len(bins))
        for feature, cut, value in zip(t.feature, t.cut, t.value, strict=True):
            node = np.zeros(len(bins), np.int64)
            for _ in range(depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (bins[at, np.maximum(f, 0)] > cut[node]), node)
            total += value[node]
        return total

    for depth in (0, 1, 5, 8):
        t = trees(depth, 20)
        start = time.perf_counter()
        want = stepwise(t, depth)
        middle = time.perf_counter()
        assert np.array_equal(B.walk(t, bins), want)
        assert depth != 5 or time.perf_counter() - middle < (middle - start) / 2


def test_blocks_hold_one_fold_and_spread(spark, monkeypatch):
    """Rows of few partitions reach every core, in blocks of one fold that
    models leaving it out pass over; the state before is not left on disk."""
    df, _, _ = table(spark)
    edges = B.bin_edges(df, FEATS)
    blocks = B._blocks(df.coalesce(1), FEATS, "churn_label", "customer_id", F.lit(1.0), edges, 2)
    rows = blocks.select("rows", "fold", F.spark_partition_id().alias("part")).collect()
    assert sum(r.rows for r in rows) == 400 and len({r.part for r in rows}) >= min(4, spark.sparkContext.defaultParallelism)
    assert len({(r.part, r.fold) for r in rows}) == len(rows)
    monkeypatch.setattr(B, "KEEP_EVERY", 1)
    before = scratch_mark(spark)
    fit(df, [B.Setting(4, 2, 0.3)])
    assert scratch_mark(spark) == before + 1


def random_tree(rng, depth, share=1.0):
    if depth == 0 or rng.random() < 0.1:
        return A.Node(share, rng.normal())
    z = rng.uniform(0.1, 0.9)
    return A.Node(share, 0.0, int(rng.integers(0, 6)), float(rng.uniform(0.1, 0.9)), random_tree(rng, depth - 1, z), random_tree(rng, depth - 1, 1 - z))


@pytest.mark.parametrize("depth", [0, 1, 3, 4, 5, 6, 9])
def test_tables_equal_the_walk(depth):
    """Looked-up attributions are those of the walk; trees too deep for tables are walked."""
    rng = np.random.default_rng(depth)
    x = np.vstack([rng.random((5_000, 6)), np.full((1, 6), np.nan)])
    roots = [random_tree(rng, depth) for _ in range(8)]
    want = np.zeros((6, len(x)))
    for root in roots:
        A._add_tree(want, np.ascontiguousarray(x.T), root)
    got = [A.tables(root, 6) for root in roots]
    assert all(len(p.tests) <= A.MOST_TESTS for t in got for p in t.parts)
    assert np.allclose(A.attributions_matrix(x, roots, 6), want.T, atol=1e-12)
    assert np.allclose(A.attributions_matrix(x, got, 6), want.T, atol=1e-12)


def test_attributions_take_a_few_additions_a_row():
    """In under half the time of walking every tree for all rows."""
    rng = np.random.default_rng(2)
    x, roots = rng.random((40_000, 6)), [random_tree(rng, 4) for _ in range(40)]
    start = time.perf_counter()
    want = np.zeros((6, len(x)))
    for root in roots:
        A._add_tree(want, np.ascontiguousarray(x.T), root)
    middle = time.perf_counter()
    A.attributions_matrix(x, roots, 6)
    assert time.perf_counter() - middle < (middle - start) / 2


@pytest.mark.parametrize("name", ["churn_model_roundtrip", "tree_attributions_check"])
def test_customers_are_not_broadcast(spark, name, monkeypatch):
    """Both sides of these joins have a row a customer."""
    from custlytics import catalog as CAT
    from custlytics.session import materialize
    df = spark.createDataFrame([(i, "s", float(i % 7), float(i % 3), float(i), i % 2, "train") for i in range(60)],
                               "customer_id long, segment string, x double, y double, z double, churn_label int, split string")
    for c in set(M.FEATURES) - set(df.columns):
        df = df.withColumn(c, F.col("x") * (len(c) % 3) + F.col("z"))
    frame = materialize(df)
    model = M.fit_churn_model(frame, n_estimators=2, max_depth=2)
    monkeypatch.setattr(CAT, "_fitted", lambda *_: (frame, model))
    out = CAT.QUERIES[name](spark, "")
    assert out.first()["customers"] == 60 and sum(out.first()[1:]) == 0
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_attributions_are_written_once(spark, monkeypatch):
    """The summary and the importance of a check come from one table."""
    from custlytics import catalog as CAT
    written = []
    attr = spark.createDataFrame([(i, f, float(i), float(i) / 3, 0.5) for i in range(20) for f in ("x", "y")],
                                 "customer_id long, feature string, value double, attribution double, expected_value double")
    monkeypatch.setattr(CAT, "_attributions", lambda *_: written.append(1) or attr)
    rows = CAT.QUERIES["attribution_summary_check"](spark, "").collect()
    assert len(written) == 1 and [tuple(r) for r in sorted(rows)] == [("x", True, True), ("y", True, True)]


def trees_of(models):
    return [a.tolist() for m in models for a in m.trees.arrays()]


def test_whole_models_equal_passes(spark, monkeypatch):
    """Grown by one task a model or level by level: the same integers, so the same trees and margins."""
    monkeypatch.setattr(B, "KEEP_EVERY", 2)
    df, x, _ = table(spark, 900)
    df = df.withColumn("weight", F.when(F.col("x") > 0.5, F.lit(2.75)).otherwise(F.lit(1.0)))
    settings = [B.Setting(5, 4, 0.3, 0.7, 0.7, 0), B.Setting(3, 3, 0.1, 1.0, 1.0, 1), B.Setting(4, 5, 0.2, 0.8, 0.4, None)]
    found = []
    for limit in (B.WHOLE_BYTES, 0):
        monkeypatch.setattr(B, "WHOLE_BYTES", limit)
        monkeypatch.setattr(B, "GROUP_CELLS", 40 if limit else 4_096)      # features counted one by one and together
        models, state = fit(df, settings, bins=16, weight=F.col("weight"))
        margins = {r.id_hash: np.frombuffer(r.margins, "<f8") for r in state.collect()}
        found.append((trees_of(models), [margins[k] for k in sorted(margins)]))
    assert found[0][0] == found[1][0] and [len(m.trees.feature) for m in models] == [5, 3, 4]
    assert len(found[0][1]) == 900 and np.allclose(found[0][1], found[1][1], atol=1e-12)


def test_whole_models_take_a_few_jobs(spark):
    """Jobs do not grow with trees and levels: one grows the models."""
    df, _, _ = table(spark)
    spark.sparkContext.setJobGroup("boosting-whole", "")
    try:
        models, state = fit(df, [B.Setting(20, 3, 0.3, fold=f) for f in (0, 1, None)])
        assert state.count() == 400
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert [len(m.trees.feature) for m in models] == [20, 20, 20]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting-whole")) <= 15      # 60 passes before


def test_models_have_a_task_each(spark):
    """No task grows two models, whatever their numbers hash to; a model without rows has no trees."""
    df, _, _ = table(spark)
    edges = B.bin_edges(df, FEATS)
    held = B._blocks(df.where("fold <> 2"), FEATS, "churn_label", "customer_id", F.lit(1.0), edges, 0)
    growing = [B._Growing(B.Setting(2, 2, 0.3, fold=i % 3), i, B.Trees.empty(2)) for i in range(12)]
    B._grow_whole(held, growing, 3, B.BINS)
    assert all(g.done() for g in growing)
    alone = [B._Growing(B.Setting(2, 2, 0.3, fold=0), 0, B.Trees.empty(2))]
    B._grow_whole(held.where("fold = 0"), alone, 3, B.BINS)
    assert len(alone[0].trees.feature) == 0
    parts = spark.createDataFrame([(i,) for i in range(12)], "slot int").repartitionById(12, "slot")
    assert sorted(tuple(r) for r in parts.select("slot", F.spark_partition_id()).collect()) == [(i, i) for i in range(12)]


def test_steps_stay_exact(spark):
    """Weights so large that a whole table's sums would leave 53 bits are added in smaller steps."""
    rng = np.random.default_rng(5)
    n = 2_000
    bins, label = rng.integers(0, 16, (3, n)).astype(np.uint8), rng.integers(0, 2, n).astype(np.int32)
    rows = B._Rows(rng.integers(0, 1 << 40, n), label, None, np.where(label == 1, 3e7, 1.0), bins, np.zeros((0, n)))
    model = B._grown(rows, B.Setting(1, 1), 16)
    g, h = B._gradients(rows, np.zeros(n), 1.0, 0)
    total = [sum(int(v) for v in x) / B.UNIT for x in (g, h)]
    assert model.value[0, 0] == -0.1 * total[0] / (total[1] + 1) and model.cover[0, 0] == total[1]


def test_features_are_counted_in_groups():
    rng = np.random.default_rng(6)
    sizes = [64, 4, 64, 20, 5, 64, 1, 256]
    groups = B._groups(sizes)
    assert sorted(i for g in groups for i in g) == list(range(8)) and len(groups) == 4
    columns = [rng.integers(0, s, 30_000).astype(np.uint8) for s in sizes]
    sums_of = np.rint(rng.normal(size=(2, 30_000)) * B.UNIT)
    counts, at = B._Counts(columns, sizes, sums_of, 256, 7_000), np.flatnonzero(rng.random(30_000) < 0.8)
    want = [[np.bincount(c[at], v[at], 256) for c in columns] for v in sums_of]
    assert np.array_equal(counts._many(at), want) and np.array_equal(counts._few(at), want)
