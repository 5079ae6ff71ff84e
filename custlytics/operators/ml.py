"""Churn model: features, stratified split, class weight, boosted trees with
random search, scoring and evaluation (F1-F11).

Two learners: second-order boosted trees (:mod:`custlytics.operators.boosting`),
which grow all candidates of a search side by side, and MLlib's
``GBTClassifier`` (logistic loss), where the parameter names map as
n_estimators -> maxIter, max_depth -> maxDepth, learning_rate -> stepSize,
subsample -> subsamplingRate, colsample_bytree -> featureSubsetStrategy (per
node in MLlib), scale_pos_weight -> weightCol.  Both score, save and load
through the same functions.

Evaluation never collects predictions: the confusion counts, the report and
the ROC-AUC (Mann-Whitney over per-score counts, bucket by bucket) are
DataFrame aggregations."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custlytics.functions.money import from_micros, half_up_div
from custlytics.operators.boosting import BoostedTrees, Setting, fit_many, held_out_margins
from custlytics.operators.select import after, boundaries
from custlytics.schemas import FEATURES, LABEL
from custlytics.session import materialize_table

# ---- fixed values (must equal the reference for identical results) --------
TEST_FRACTION = 0.2
SEED = 42
CV_FOLDS = 3
SEARCH_ITERATIONS = 10
PARAM_GRID = {
    "n_estimators": [100, 150, 200],
    "max_depth": [3, 4, 5],
    "learning_rate": [0.05, 0.1, 0.2],
    "subsample": [0.8, 1.0],
    "colsample_bytree": [0.8, 1.0],
}
# The setting the reference publishes as its search's best.
BEST_PARAMS = {"n_estimators": 200, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8}
# ---------------------------------------------------------------------------


def assemble_features(df: DataFrame, cols: Sequence[str] = FEATURES, label: str = LABEL,
                      id_col: str = "customer_id", keep: Sequence[str] = ()) -> DataFrame:
    """id, ``keep`` columns as they are, the non-leaking features as
    double and the label.  A null feature becomes 0: MLlib's trees, unlike the
    reference's, take no missing values."""
    return df.select(id_col, *keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols],
                     F.col(label).cast("int").alias(label))


def _allocate(counts: Mapping[int, int], test: float) -> dict[int, int]:
    """Test rows per class: floor shares, the remainder to the largest
    fractional parts (ties to the smaller class value), total ceil(test*n)."""
    n = sum(counts.values())
    target = math.ceil(test * n)
    share = {c: test * k for c, k in counts.items()}
    alloc = {c: math.floor(s) for c, s in share.items()}
    rest = target - sum(alloc.values())
    for c in sorted(counts, key=lambda c: (-(share[c] - alloc[c]), c))[:max(0, rest)]:
        alloc[c] += 1
    return alloc


def _hash48(text: Column) -> Column:
    """48 bits of an md5: a number that any engine can compute."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")


def stratified_split(df: DataFrame, label: str = LABEL, test: float = TEST_FRACTION,
                     seed: int = SEED, folds: int = CV_FOLDS, id_col: str = "customer_id") -> DataFrame:
    """exact stratified hold-out plus CV folds, appended as ``split`` and
    ``fold``.

    The first allocated rows of each class, by a hash of ``seed:id`` and then
    the id, are the test set; the last of them is located by counting, so the
    split is one comparison with a boundary per class: no sort, no write, no
    join.  Folds come from a second hash.  Rows without a label belong to
    neither part (null ``split``)."""
    text = F.col(id_col).cast("string")
    keyed = df.withColumns({"_h": _hash48(F.concat(F.lit(f"{seed}:"), text)),
                            "_f": (_hash48(F.concat(F.lit(f"{seed}:fold:"), text)) % folds).cast("int")})
    counts = {r[0]: int(r[1]) for r in keyed.where(F.col(label).isNotNull()).groupBy(label).count().collect()}  # a row a class
    alloc = _allocate(counts, test)
    order = [("_h", True), (id_col, True)]
    last = {(c,): [k - 1] for c, k in alloc.items() if k}
    found = boundaries(keyed, order, last, {(c,): counts[c] for (c,) in last}, [label]) if last else {}
    held = F.lit(False)
    for (group, _), boundary in found.items():
        held = held | ((F.col(label) == F.lit(group[0])) & ~after(keyed, order, boundary))
    split = F.when(F.col(label).isNull(), F.lit(None).cast("string")).when(held, "test").otherwise("train")
    return (keyed.withColumn("split", split)
            .withColumn("fold", F.when(F.col("split") == "train", F.col("_f"))).drop("_h", "_f"))


def class_weight(train: DataFrame, label: str = LABEL) -> DataFrame:
    """negatives, positives and their ratio (the positive-class weight)."""
    return train.agg(F.count_if(F.col(label) == 0).alias("negatives"),
                     F.count_if(F.col(label) == 1).alias("positives")).withColumn(
        "scale_pos_weight", F.try_divide(F.col("negatives").cast("double"), F.col("positives")))


def with_weight(train: DataFrame, label: str = LABEL, weight_col: str = "weight") -> DataFrame:
    """Weight 1 for negatives and negatives/positives for positives (a
    one-row scalar subquery, no collect)."""
    ratio = class_weight(train, label).select("scale_pos_weight").scalar()
    return train.withColumn(weight_col, F.when(F.col(label) == 1, F.coalesce(ratio, F.lit(1.0)))
                            .otherwise(F.lit(1.0)))


def churn_classifier(features: Sequence[str] = FEATURES, label: str = LABEL, weight_col: str = "weight",
                     seed: int = SEED, **params) -> tuple[Pipeline, GBTClassifier]:
    """assembler + logistic-loss boosted trees."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol=weight_col,
                        lossType="logistic", seed=seed, checkpointInterval=10)
    gbt.setParams(**_gbt_params(params))
    return Pipeline(stages=[assembler, gbt]), gbt


def _gbt_params(p: Mapping) -> dict:
    out = {}
    names = {"n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize",
             "subsample": "subsamplingRate"}
    for k, v in p.items():
        if k in names:
            out[names[k]] = v
        elif k == "colsample_bytree":
            out["featureSubsetStrategy"] = "all" if float(v) >= 1.0 else str(float(v))
        else:
            out[k] = v
    return out


def sample_param_grid(grid: Mapping[str, Sequence] = PARAM_GRID, n_iter: int = SEARCH_ITERATIONS,
                      seed: int = SEED) -> list[dict]:
    """``n_iter`` distinct combinations drawn without replacement."""
    keys = sorted(grid)
    combos = [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]
    rng = random.Random(seed)
    return rng.sample(combos, min(n_iter, len(combos)))


@dataclass
class Search:
    """A finished random search: the best setting's model fitted on all
    training rows, (setting, mean AUC) of every draw, and each training row's
    margin under the models that did not see it (model, label, margin; model =
    draw * folds + fold)."""
    best: BoostedTrees
    tried: list[tuple[dict, float]]
    held_out: DataFrame


def search(train: DataFrame, grid: Mapping[str, Sequence] = PARAM_GRID, n_iter: int = SEARCH_ITERATIONS,
           folds: int = CV_FOLDS, seed: int = SEED, features: Sequence[str] = FEATURES, label: str = LABEL,
           id_col: str = "customer_id") -> Search:
    """random search over the grid with stratified folds (``fold`` from
    ``stratified_split``), scored by ROC-AUC.

    The models of all draws and folds and a refit of every draw on all rows
    are grown in the same passes; the held-out scores come from the margins
    that growing kept.  Ties go to the earlier draw."""
    draws = sample_param_grid(grid, n_iter, seed)
    settings = [Setting(**d, fold=f, seed=seed) for d in draws for f in range(folds)]
    ratio = class_weight(train, label).first()["scale_pos_weight"]
    weight = F.when(F.col(label) == 1, F.lit(1.0 if ratio is None else ratio)).otherwise(F.lit(1.0))
    refits = [Setting(**d, seed=seed) for d in draws]
    models, state = fit_many(train, settings + refits, features=features, label=label, id_col=id_col, weight=weight)
    held = materialize_table(held_out_margins(state, settings), "held-out")
    per = held.groupBy("model", "margin").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    aucs = {r["model"]: r["roc_auc"] for r in auc_of_counts(
        per, "margin", "pos", "neg", 6, bounds=_bounds(held, "margin"), by=["model"]).collect()}   # a row a model
    tried = []
    for i, d in enumerate(draws):
        mine = [a for f in range(folds) if (a := aucs.get(i * folds + f)) is not None]
        tried.append((d, sum(mine) / len(mine) if mine else 0.0))
    best = max(range(len(draws)), key=lambda i: (tried[i][1], -i))
    return Search(models[len(settings) + best], tried, held)


def random_search(train: DataFrame, grid: Mapping[str, Sequence] = PARAM_GRID, n_iter: int = SEARCH_ITERATIONS, **options):
    """(best model, list of (setting, mean AUC))."""
    done = search(train, grid, n_iter, **options)
    return done.best, done.tried


def fit_boosted_trees(train: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL, seed: int = SEED,
                      id_col: str = "customer_id", **params) -> BoostedTrees:
    """one second-order model, classes weighted by their ratio."""
    ratio = class_weight(train, label).first()["scale_pos_weight"]
    weight = F.when(F.col(label) == 1, F.lit(1.0 if ratio is None else ratio)).otherwise(F.lit(1.0))
    train = train if "fold" in train.columns else train.withColumn("fold", F.lit(None).cast("int"))
    models, _ = fit_many(train, [Setting(**params, seed=seed)], features=features, label=label, id_col=id_col, weight=weight)
    return models[0]


def fit_churn_model(train: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL,
                    seed: int = SEED, **params) -> PipelineModel:
    pipe, _ = churn_classifier(features, label, seed=seed, **params)
    return pipe.fit(with_weight(train, label))


def score(model: PipelineModel | BoostedTrees, df: DataFrame, prob_col: str = "churn_probability") -> DataFrame:
    """predicted class and positive-class probability."""
    if isinstance(model, BoostedTrees):
        return model.transform(df, prob_col)
    out = model.transform(df)
    return (out.withColumn(prob_col, vector_to_array(F.col("probability"))[1])
            .withColumn("prediction", F.col("prediction").cast("int"))
            .drop("features", "rawPrediction", "probability"))


def churn_predictions(model: PipelineModel | BoostedTrees, base: DataFrame, features: Sequence[str] = FEATURES,
                      label: str = LABEL) -> DataFrame:
    """every customer scored; id, segment, label, probability, CLV and
    the features (CLV once).  The columns ride through the model: no join."""
    feats = assemble_features(base, features, label, keep=["segment"])
    rest = [c for c in features if c != "clv_proxy"]
    return score(model, feats).select("customer_id", "segment", label, "clv_proxy", *rest, "churn_probability", "prediction")


def save_model(model: PipelineModel | BoostedTrees, path: str) -> str:
    """F11"""
    if isinstance(model, BoostedTrees):
        return model.save(SparkSession.active(), path)
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel | BoostedTrees:
    """either learner's model; MLlib's folders hold ``metadata``."""
    spark = SparkSession.active()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return PipelineModel.load(path)
    return BoostedTrees.load(spark, path)


# -------------------------------------------------------------- evaluation

def confusion_matrix(pred: DataFrame, label: str = LABEL, prediction: str = "prediction",
                     classes: Sequence[int] = (0, 1)) -> DataFrame:
    """F8: counts per (label, prediction) with empty cells as 0."""
    spark = pred.sparkSession
    cells = spark.createDataFrame([(a, b) for a in classes for b in classes],
                                  f"{label} int, {prediction} int")
    counts = pred.groupBy(F.col(label).cast("int").alias(label),
                          F.col(prediction).cast("int").alias(prediction)).agg(F.count(F.lit(1)).alias("count"))
    # at most len(classes)**2 counts: broadcast by construction
    counts = counts.where(F.col(label).isin(list(classes)) & F.col(prediction).isin(list(classes)))
    return (cells.join(F.broadcast(counts), [label, prediction], "left")
            .select(label, prediction, F.coalesce("count", F.lit(0)).alias("count"))
            .orderBy(label, prediction))


def _r6(c):
    return F.round(c, 6)


def classification_report(pred: DataFrame, label: str = LABEL, prediction: str = "prediction",
                          classes: Sequence[int] = (0, 1)) -> DataFrame:
    """per-class precision/recall/F1/support, accuracy, macro and weighted
    averages (rounded to 6 decimals; undefined ratios are null)."""
    cm = confusion_matrix(pred, label, prediction, classes)
    per = cm.groupBy().agg(*[
        F.sum(F.when((F.col(label) == c) & (F.col(prediction) == c), F.col("count")).otherwise(0)).alias(f"tp{c}")
        for c in classes], *[
        F.sum(F.when(F.col(prediction) == c, F.col("count")).otherwise(0)).alias(f"pp{c}") for c in classes], *[
        F.sum(F.when(F.col(label) == c, F.col("count")).otherwise(0)).alias(f"s{c}") for c in classes],
        F.sum("count").alias("total"))
    rows = []
    for c in classes:
        p = F.try_divide(F.col(f"tp{c}").cast("double"), F.col(f"pp{c}"))
        r = F.try_divide(F.col(f"tp{c}").cast("double"), F.col(f"s{c}"))
        f1 = F.try_divide(2 * p * r, p + r)
        rows.append((str(c), p, r, f1, F.col(f"s{c}")))
    acc = F.try_divide(sum((F.col(f"tp{c}") for c in classes), F.lit(0)).cast("double"), F.col("total"))
    k = len(classes)
    macro = [sum((x[i] for x in rows), F.lit(0.0)) / k for i in (1, 2, 3)]
    weighted = [F.try_divide(sum((x[i] * x[4] for x in rows), F.lit(0.0)), F.col("total")) for i in (1, 2, 3)]
    out_rows = [*rows,
                ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, F.col("total")),
                ("macro avg", *macro, F.col("total")),
                ("weighted avg", *weighted, F.col("total"))]
    structs = [F.struct(F.lit(name).alias("class"), _r6(p).alias("precision"), _r6(r).alias("recall"),
                        _r6(f).alias("f1_score"), s.cast("bigint").alias("support"))
               for name, p, r, f, s in out_rows]
    return per.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def roc_auc(pred: DataFrame, label: str = LABEL, score_col: str = "churn_probability",
            decimals: int = 4, partitions: int | None = None) -> DataFrame:
    """ROC-AUC as the Mann-Whitney statistic (ties count one half),
    rounded half-up from exact integers.

    Scores are reduced to (score, positives, negatives) and dealt to buckets
    of ascending scores.  Negatives below a score are those of earlier buckets
    (one small table) and those below it in its own bucket: no sort of all
    scores, nothing written, nothing collected but the buckets' bounds."""
    per = pred.groupBy(F.col(score_col).alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    return auc_of_counts(per, "_s", "_pos", "_neg", decimals, partitions, _bounds(pred, score_col))


#: Buckets of scores: AUC_BUCKETS groups of AUC_BUCKETS each.
AUC_BUCKETS = 16


def _bounds(df: DataFrame, score_col: str) -> list[float]:
    """Approximate quantiles of the scores, ascending (one aggregate)."""
    n = AUC_BUCKETS * AUC_BUCKETS
    shares = ", ".join(f"{i / n}D" for i in range(1, n))
    got = df.select(F.col(score_col).cast("double").alias("s")).agg(F.expr(f"percentile_approx(s, array({shares}), {10 * n})")).first()[0]
    return sorted(x for x in got or [] if not math.isnan(x))


def _bucket(score: Column, bounds: Sequence[float]) -> Column:
    """How many of the ascending bounds lie below a score (null: none), by
    comparison with every AUC_BUCKETS-th first and then with those between."""
    if not bounds:
        return F.lit(0)
    groups = [bounds[at:at + AUC_BUCKETS] for at in range(0, len(bounds), AUC_BUCKETS)]

    def listed(xs):
        return "array(" + ", ".join(f"CAST('{x}' AS DOUBLE)" for x in xs) + ")"

    first, every = listed([g[0] for g in groups[1:]]) if groups[1:] else "array(CAST('Infinity' AS DOUBLE))", ", ".join(listed(g) for g in groups)
    past = F.size(F.filter(F.expr(first), lambda b: score > b))
    fine = F.size(F.filter(F.element_at(F.expr(f"array({every})"), past + 1), lambda b: score > b))
    return past * AUC_BUCKETS + fine


def auc_of_counts(per: DataFrame, score_col: str, pos: str, neg: str, decimals: int = 4,
                  partitions: int | None = None, bounds: Sequence[float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """F9 from one row a score with its positives and negatives, for each group
    of ``by``; ``partitions`` fixes the tasks that the buckets are dealt over."""
    bounds = _bounds(per, score_col) if bounds is None else bounds
    per = per.select(*by, F.col(score_col).alias("_s"), F.col(pos).alias("_pos"), F.col(neg).alias("_neg"),
                     _bucket(F.col(score_col).cast("double"), bounds).alias("_bucket"))
    per = per.repartition(partitions, *by, "_bucket") if partitions else per
    inside = Window.partitionBy(*by, "_bucket").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_within", F.coalesce(F.sum("_neg").over(inside), F.lit(0)))
    # one row a bucket: its negatives, and twice the pairs of its positives with negatives of its own
    dec = lambda c: c.cast("decimal(19,0)")
    buckets = per.groupBy(*by, "_bucket").agg(
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"), F.sum(dec(F.col("_pos")) * dec(2 * F.col("_within") + F.col("_neg"))).alias("_own"))
    whole = buckets.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_bucket", "_p", "_n", "_own"))).alias("_b"))   # AUC_BUCKETS^2 + 1 rows at most
    wide = "decimal(38,0)"
    step = lambda a, b: F.struct(                            # noqa: E731
        (a["below"] + b["_n"]).cast(wide).alias("below"), (a["pos"] + b["_p"]).cast(wide).alias("pos"),
        (a["num2"] + b["_own"] + 2 * dec(b["_p"]) * dec(a["below"])).cast(wide).alias("num2"))
    start = F.struct(*[F.lit(0).cast(wide).alias(c) for c in ("below", "pos", "num2")])
    tot = whole.select(*by, F.aggregate("_b", start, step).alias("t")).select(
        *by, F.col("t.pos").alias("positives"), F.col("t.below").alias("negatives"), F.col("t.num2").alias("_num2"))
    # each factor as a decimal: the product of two counts leaves 64 bits
    den = (F.col("positives").cast("decimal(19,0)") * F.col("negatives").cast("decimal(18,0)") * 2).cast("decimal(38,0)")
    scale = 10 ** decimals
    auc = F.when(den > 0, from_micros(half_up_div(F.col("_num2") * scale, den), scale))
    return tot.select(*by, auc.alias("roc_auc"), F.col("positives").cast("bigint").alias("positives"),
                      F.col("negatives").cast("bigint").alias("negatives"))


def evaluator_auc(pred: DataFrame, label: str = LABEL, score_col: str = "churn_probability") -> float:
    """ROC-AUC from MLlib's evaluator with no down-sampling (cross-check)."""
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=score_col,
                                       metricName="areaUnderROC", numBins=0)
    return ev.evaluate(pred.withColumn(label, F.col(label).cast("double")))
