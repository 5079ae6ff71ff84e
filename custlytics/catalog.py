"""Registered queries: each builds a DataFrame from the test tables at
``sf_dir``.  Names match the keys of :mod:`custlytics.oracle`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlytics.operators import attribution as A
from custlytics.operators import cohort as C
from custlytics.operators import customer as E
from custlytics.operators import ml as M
from custlytics.operators import quality as Q
from custlytics.operators import rfm as R
from custlytics.operators import views as V
from custlytics.operators.rank import global_rank
from custlytics.plans.pushdown import count_through_dimension, distinct_through_dimension
from custlytics.schemas import TRANSACTIONS
from custlytics.session import ON_RELEASE, materialize, scratch_path, track
from custlytics.sources import tables as TB
from custlytics.sources import testdata as TD
from custlytics.sources import transactions as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _tx(spark, sf_dir, **kw):
    return TD.transactions(spark, sf_dir, **kw)


# ------------------------------------------------------------------ RFM (C)

@query("rfm")
def q_rfm(spark, sf_dir):
    return R.rfm(_tx(spark, sf_dir, lines=False))


def _segments(spark, sf_dir):
    return R.rfm_segments(_tx(spark, sf_dir, lines=False))


@query("global_rank")
def q_global_rank(spark, sf_dir):
    base = R.rfm(_tx(spark, sf_dir, lines=False), sort=False)
    return global_rank(base, R.FREQUENCY_ORDER, "rank").select(
        "customer_id", "frequency", "monetary", "rank")


@query("score_recency")
def q_score_recency(spark, sf_dir):
    return _segments(spark, sf_dir).select("customer_id", "recency", "r_score")


@query("score_frequency")
def q_score_frequency(spark, sf_dir):
    return _segments(spark, sf_dir).select("customer_id", "frequency", "monetary", "f_score")


@query("score_monetary")
def q_score_monetary(spark, sf_dir):
    return _segments(spark, sf_dir).select("customer_id", "monetary", "m_score")


@query("rfm_scored")
def q_rfm_scored(spark, sf_dir):
    return _segments(spark, sf_dir).drop("segment")


@query("rfm_segments")
def q_rfm_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query("segment_summary")
def q_segment_summary(spark, sf_dir):
    return R.segment_summary(_segments(spark, sf_dir), decimals=6)


@query("segment_counts")
def q_segment_counts(spark, sf_dir):
    return R.value_counts(_segments(spark, sf_dir), "segment", "customers")


# ------------------------------------------------------------ quality (B)


@query("dq_total_transactions")
def q_dq_total(spark, sf_dir):
    return Q.total_transactions(_tx(spark, sf_dir, lines=False))


@query("dq_total_customers")
def q_dq_customers(spark, sf_dir):
    return Q.total_customers(_tx(spark, sf_dir, lines=False))


@query("dq_date_range")
def q_dq_dates(spark, sf_dir):
    return Q.date_range(_tx(spark, sf_dir, lines=False))


@query("dq_null_counts")
def q_dq_nulls(spark, sf_dir):
    return Q.null_counts(_tx(spark, sf_dir))


@query("dq_duplicate_ids")
def q_dq_dups(spark, sf_dir):
    return Q.duplicate_ids(_tx(spark, sf_dir, lines=False))


@query("dq_duplicate_line_ids")
def q_dq_line_dups(spark, sf_dir):
    return Q.duplicate_ids(TD.line_transactions(spark, sf_dir), ["order_id", "line_number"])


@query("dq_duplicate_preview")
def q_dq_duplicate_preview(spark, sf_dir):
    return Q.duplicate_preview(TD.line_transactions(spark, sf_dir), ["order_id", "line_number"])


@query("dq_nonpositive_value")
def q_dq_nonpos_value(spark, sf_dir):
    return Q.nonpositive_rows(_tx(spark, sf_dir, lines=False), "order_value",
                              "non_positive_order_value_rows")


@query("dq_nonpositive_event_value")
def q_dq_nonpos_event(spark, sf_dir):
    return Q.nonpositive_rows(TD.purchase_events(spark, sf_dir), "order_value",
                              "non_positive_order_value_rows")


@query("dq_nonpositive_quantity")
def q_dq_nonpos_qty(spark, sf_dir):
    return Q.nonpositive_rows(_tx(spark, sf_dir), "quantity", "non_positive_quantity_rows")


@query("dq_one_time_customers")
def q_dq_one_time(spark, sf_dir):
    return Q.one_time_customers(_tx(spark, sf_dir, lines=False))


@query("dq_repeat_customers")
def q_dq_repeat(spark, sf_dir):
    return Q.repeat_customers(_tx(spark, sf_dir, lines=False))


@query("dist_channel")
def q_dist_channel(spark, sf_dir):
    return Q.distribution(_tx(spark, sf_dir, lines=False), "channel")


@query("dist_category")
def q_dist_category(spark, sf_dir):
    lines = TD.line_transactions(spark, sf_dir)
    part = TD.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("product_category"))
    counts = count_through_dimension(lines, "part_id", part, "p_partkey",
                                     ["product_category"], "transactions")
    return counts.orderBy(F.desc("transactions"), F.asc_nulls_first("product_category"))


@query("dist_state")
def q_dist_state(spark, sf_dir):
    orders = _tx(spark, sf_dir, lines=False)
    states = TD.customer_states(spark, sf_dir)
    counts = distinct_through_dimension(orders, "customer_id", states, "customer_id",
                                        ["customer_state"], "customers")
    return counts.orderBy(F.desc("customers"), F.asc_nulls_first("customer_state"))


@query("dist_state_generic")
def q_dist_state_generic(spark, sf_dir):
    # customers first, so that a hot customer is one row in the join
    customers = _tx(spark, sf_dir, lines=False).select("customer_id").distinct()
    return Q.distinct_distribution(customers.join(TD.customer_states(spark, sf_dir), "customer_id", "left"), "customer_state")


@query("dq_suite")
def q_dq_suite(spark, sf_dir):
    return Q.run_validation(_tx(spark, sf_dir))


# -------------------------------------------------------------- cohort (D)


@query("first_purchase")
def q_first_purchase(spark, sf_dir):
    return C.first_purchase(_tx(spark, sf_dir, lines=False))


@query("cohort_assign")
def q_cohort_assign(spark, sf_dir):
    return C.cohort_assign(_tx(spark, sf_dir, lines=False))


@query("cohort_counts")
def q_cohort_counts(spark, sf_dir):
    return C.cohort_counts(_tx(spark, sf_dir, lines=False))


@query("cohort_size")
def q_cohort_size(spark, sf_dir):
    return C.cohort_size(C.cohort_counts(_tx(spark, sf_dir, lines=False)))


def _retention(spark, sf_dir):
    return C.cohort_retention(_tx(spark, sf_dir, lines=False), sort=False)


@query("cohort_retention")
def q_cohort_retention(spark, sf_dir):
    return C.cohort_retention(_tx(spark, sf_dir, lines=False))


@query("cohort_12m")
def q_cohort_12m(spark, sf_dir):
    return C.filter_cohorts(_retention(spark, sf_dir), 12).orderBy("cohort_month", "cohort_index")


@query("cohort_options")
def q_cohort_options(spark, sf_dir):
    return C.cohort_options(C.filter_cohorts(_retention(spark, sf_dir), 12))


@query("cohort_latest")
def q_cohort_latest(spark, sf_dir):
    return C.latest_retention(C.filter_cohorts(_retention(spark, sf_dir), 12))


@query("cohort_matrix")
def q_cohort_matrix(spark, sf_dir):
    return C.cohort_matrix(C.filter_cohorts(_retention(spark, sf_dir), 12))


# ------------------------------------------------------- churn and CLV (E)


def _churn(spark, sf_dir, sort=False):
    return E.customer_churn(_tx(spark, sf_dir), sort=sort)


@query("customer_churn")
def q_customer_churn(spark, sf_dir):
    return _churn(spark, sf_dir, sort=True)


@query("customer_churn_unrounded")
def q_customer_churn_unrounded(spark, sf_dir):
    # spend, AOV and discount unrounded; CLV from the unrounded AOV
    return E.customer_churn(_tx(spark, sf_dir), rounded=False, sort=False)


@query("customer_base")
def q_customer_base(spark, sf_dir):
    return E.customer_base(_tx(spark, sf_dir), sort=False)


@query("recent_activity")
def q_recent_activity(spark, sf_dir):
    return E.recent_activity(_tx(spark, sf_dir, lines=False))


@query("churn_label")
def q_churn_label(spark, sf_dir):
    return _churn(spark, sf_dir).select("customer_id", "days_since_last_purchase", "churn_label")


@query("clv_proxy")
def q_clv_proxy(spark, sf_dir):
    return _churn(spark, sf_dir).select("customer_id", "total_transactions", "avg_order_value",
                                        "active_months", "clv_proxy")


@query("churn_distribution")
def q_churn_distribution(spark, sf_dir):
    return R.value_counts(_churn(spark, sf_dir), "churn_label", "customers")


@query("model_base")
def q_model_base(spark, sf_dir):
    return E.customer_model_base(_tx(spark, sf_dir))


# ---------------------------------------------------- analyst views (G)


VIEW_FILTER = dict(segments=("High-Value", "At-Risk"), prob=(0.05, 0.95), clv=(100000.0, 3000000.0))


def _pred(spark, sf_dir, stored=False):
    # the customer table is written once: scores are a projection of it, and
    # filters on its columns push down to its scan; ``stored`` writes the scored
    # table too, so that filters on segments and scores do
    base = materialize(E.customer_features(_tx(spark, sf_dir)))
    most = base.agg(F.max("days_since_last_purchase")).first()[0]
    scored = V.churn_scores(E.customer_model_base(None, features=base), max_days=most)
    return materialize(scored) if stored else scored


@query("segment_options")
def q_segment_options(spark, sf_dir):
    return V.segment_options(_pred(spark, sf_dir))


@query("clv_bounds")
def q_clv_bounds(spark, sf_dir):
    return V.clv_bounds(_pred(spark, sf_dir))


@query("filtered_customers")
def q_filtered_customers(spark, sf_dir):
    return V.filter_customers(_pred(spark, sf_dir, stored=True), **VIEW_FILTER)


@query("risk_band")
def q_risk_band(spark, sf_dir):
    return V.with_risk_band(_pred(spark, sf_dir)).select("customer_id", "churn_probability", "risk_band")


@query("kpi_row")
def q_kpi_row(spark, sf_dir):
    return V.kpis(_pred(spark, sf_dir), decimals=6)


@query("kpi_row_filtered")
def q_kpi_row_filtered(spark, sf_dir):
    return V.kpis(V.filter_customers(_pred(spark, sf_dir, stored=True), **VIEW_FILTER), decimals=6)


@query("segment_performance")
def q_segment_performance(spark, sf_dir):
    return V.segment_performance(_pred(spark, sf_dir), decimals=6)


@query("segment_metric")
def q_segment_metric(spark, sf_dir):
    return V.segment_metric(V.segment_performance(_pred(spark, sf_dir), decimals=6), "avg_clv_proxy")


@query("risk_summary")
def q_risk_summary(spark, sf_dir):
    return V.risk_summary(_pred(spark, sf_dir), decimals=6)


@query("risk_summary_filtered")
def q_risk_summary_filtered(spark, sf_dir):
    # a filter that leaves the low-risk band empty
    return V.risk_summary(V.filter_customers(_pred(spark, sf_dir, stored=True), prob=(0.5, 1.0)), decimals=6)


@query("prob_histogram")
def q_prob_histogram(spark, sf_dir):
    return V.histogram(_pred(spark, sf_dir))


@query("box_churn_probability")
def q_box_prob(spark, sf_dir):
    return V.box_stats(_pred(spark, sf_dir), "churn_probability", decimals=6)


@query("box_clv")
def q_box_clv(spark, sf_dir):
    return V.box_stats(_pred(spark, sf_dir), "clv_proxy", decimals=6)


@query("top_risk")
def q_top_risk(spark, sf_dir):
    return V.top_n(_pred(spark, sf_dir), "churn_probability", 25, cols=V.TOP_COLUMNS)


@query("top_clv")
def q_top_clv(spark, sf_dir):
    return V.top_n(_pred(spark, sf_dir), "clv_proxy", 25, cols=V.TOP_COLUMNS)


@query("bottom_clv")
def q_bottom_clv(spark, sf_dir):
    return V.top_n(_pred(spark, sf_dir), "clv_proxy", 25, ascending=True, cols=V.TOP_COLUMNS)


@query("customer_table")
def q_customer_table(spark, sf_dir):
    return V.top_n(V.filter_customers(_pred(spark, sf_dir, stored=True), **VIEW_FILTER), "monetary", 50,
                   ascending=True)


@query("clv_vs_risk")
def q_clv_vs_risk(spark, sf_dir):
    return V.points(_pred(spark, sf_dir))


# ------------------------------------------------------- churn model (F)


def _model_frame(spark, sf_dir):
    """Model base with features, split and fold, checkpointed once."""
    base = materialize(E.customer_model_base(_tx(spark, sf_dir)))
    return materialize(M.stratified_split(M.assemble_features(base, keep=["segment"])))


def _eval_frame(spark, sf_dir):
    """Hold-out rows with a deterministic, non-leaking score (1 - lifespan /
    max lifespan) so the evaluation operators are checkable in SQL."""
    base = materialize(E.customer_churn(_tx(spark, sf_dir, lines=False), sort=False).select(
        "customer_id", "churn_label", "customer_lifespan_days"))
    mx = base.agg(F.max("customer_lifespan_days")).first()[0]
    score = F.lit(1.0) - F.col("customer_lifespan_days").cast("double") / F.lit(mx)
    split = M.stratified_split(base.select("customer_id", "churn_label", score.alias("churn_probability")))
    ev = split.where(F.col("split") == "test")
    return ev.withColumn("prediction", (F.col("churn_probability") > 0.5).cast("int"))


@query("model_features")
def q_model_features(spark, sf_dir):
    return M.assemble_features(E.customer_model_base(_tx(spark, sf_dir)))


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    # the label needs no scores: the split reads the churn table itself
    base = materialize(E.customer_churn(_tx(spark, sf_dir, lines=False), sort=False).select("customer_id", "churn_label"))
    return M.stratified_split(base)


@query("stratified_split_sizes")
def q_stratified_split_sizes(spark, sf_dir):
    s = q_stratified_split(spark, sf_dir)
    return s.groupBy("churn_label", "split").agg(F.count(F.lit(1)).alias("rows"))


@query("class_weight")
def q_class_weight(spark, sf_dir):
    return M.class_weight(q_stratified_split(spark, sf_dir).where(F.col("split") == "train"))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_eval_frame(spark, sf_dir))


@query("classification_report")
def q_classification_report(spark, sf_dir):
    return M.classification_report(_eval_frame(spark, sf_dir))


@query("roc_auc")
def q_roc_auc(spark, sf_dir):
    return M.roc_auc(_eval_frame(spark, sf_dir))


# Model-fitting queries: a fitted model is not SQL, so each has a companion
# `*_check` whose invariants are.  One fit, with the reference's published
# best setting, serves all of them in a session.
_FITTED: dict[tuple[str, str], tuple] = {}
ON_RELEASE.append(_FITTED.clear)                             # its frame is a scratch folder


def _fitted(spark, sf_dir):
    """(frame, model) of the whole table: materialised frame, fitted once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        frame = _model_frame(spark, sf_dir)
        _FITTED[key] = (frame, M.fit_churn_model(frame.where(F.col("split") == "train"), **M.BEST_PARAMS))
    return _FITTED[key]


@query("churn_model_scores")
def q_churn_model_scores(spark, sf_dir):
    frame, model = _fitted(spark, sf_dir)
    return M.score(model, frame.where(F.col("split") == "test")).select(
        "customer_id", "churn_label", "churn_probability", "prediction")


@query("churn_model_report")
def q_churn_model_report(spark, sf_dir):
    frame, model = _fitted(spark, sf_dir)
    return M.classification_report(M.score(model, frame.where(F.col("split") == "test")))


@query("churn_model_auc")
def q_churn_model_auc(spark, sf_dir):
    frame, model = _fitted(spark, sf_dir)
    return M.roc_auc(M.score(model, frame.where(F.col("split") == "test")))


def _searched(spark, sf_dir):
    """(frame, search) over the whole grid: once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, "search")
    if key not in _FITTED:
        frame = _model_frame(spark, sf_dir)
        _FITTED[key] = (frame, M.search(frame.where(F.col("split") == "train")))
    return _FITTED[key]


def _spelled(params):
    return ", ".join(f"{k}={v}" for k, v in sorted(params.items()))


@query("churn_model_search")
def q_churn_model_search(spark, sf_dir):
    """the whole grid, 10 draws x 3 folds."""
    _, done = _searched(spark, sf_dir)
    rows = [(i, _spelled(p), float(auc)) for i, (p, auc) in enumerate(done.tried)]
    return spark.createDataFrame(rows, "candidate int, params string, cv_auc double")


@query("churn_model_search_check")
def q_churn_model_search_check(spark, sf_dir):
    """Each draw's AUC again, by another evaluator from its held-out scores."""
    _, done = _searched(spark, sf_dir)
    counts = {r["model"]: r["count"] for r in done.held_out.groupBy("model").count().collect()}   # a row a model
    rows = []
    for i, (p, auc) in enumerate(done.tried):
        models = range(i * M.CV_FOLDS, (i + 1) * M.CV_FOLDS)
        again = [M.evaluator_auc(done.held_out.where(F.col("model") == m), "label", "margin") for m in models]
        rows.append((i, _spelled(p), sum(counts[m] for m in models), abs(sum(again) / len(again) - auc) < 1e-5))
    return spark.createDataFrame(rows, "candidate int, params string, rows bigint, same_auc boolean")


@query("boosted_model_roundtrip")
def q_boosted_model_roundtrip(spark, sf_dir):
    """The search's best model, saved and loaded again: rows whose score,
    or whose attributions' sum, differs from the fitted model's."""
    frame, done = _searched(spark, sf_dir)
    again = M.load_model(M.save_model(done.best, _scratch(spark, "boosted-model")))
    a = M.score(done.best, frame).select("customer_id", F.col("churn_probability").alias("a"))
    b = M.score(again, frame).select("customer_id", F.col("churn_probability").alias("b"))
    per = A.tree_attributions(again, frame).groupBy("customer_id").agg((F.sum("attribution") + F.first("expected_value")).alias("margin"))
    p = 1.0 / (1.0 + F.exp(-F.col("margin")))
    # a row a customer on every side, so never a broadcast
    return a.join(b.hint("merge"), "customer_id").join(per.hint("merge"), "customer_id").agg(
        F.count(F.lit(1)).alias("customers"),
        *_violations(other_score=F.col("a") == F.col("b"), bad_sum=F.abs(p - F.col("a")) < 1e-8, bad_probability=F.col("a").between(0.0, 1.0)))


@query("churn_model_roundtrip")
def q_churn_model_roundtrip(spark, sf_dir):
    """MLlib's model, saved and loaded again."""
    frame, model = _fitted(spark, sf_dir)
    again = M.load_model(M.save_model(model, _scratch(spark, "churn-model")))
    a = M.score(model, frame).select("customer_id", F.col("churn_probability").alias("a"))
    b = M.score(again, frame).select("customer_id", F.col("churn_probability").alias("b"))
    # a row a customer on both sides, so never a broadcast
    return a.join(b.hint("merge"), "customer_id").agg(F.count(F.lit(1)).alias("customers"), *_violations(other_score=F.col("a") == F.col("b")))


@query("churn_predictions")
def q_churn_predictions(spark, sf_dir):
    frame, model = _fitted(spark, sf_dir)
    return M.churn_predictions(model, frame)


def _violations(**conditions):
    """Rows on which a condition that must hold does not, one count each."""
    return [F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]


@query("churn_model_scores_check")
def q_churn_model_scores_check(spark, sf_dir):
    p = F.col("churn_probability")
    return q_churn_model_scores(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("customer_id").alias("customers"),
        F.count_if(F.col("churn_label") == 1).alias("churned"),
        *_violations(bad_probability=p.between(0.0, 1.0), bad_prediction=F.col("prediction") == (p > 0.5).cast("int")))


@query("churn_model_report_check")
def q_churn_model_report_check(spark, sf_dir):
    rows = q_churn_model_report(spark, sf_dir)
    return rows.select("class", "support", F.coalesce(F.col("f1_score").between(0.0, 1.0), F.lit(True)).alias("f1_in_range"))


@query("churn_model_auc_check")
def q_churn_model_auc_check(spark, sf_dir):
    # better than chance on the hold-out, from all its pairs
    return q_churn_model_auc(spark, sf_dir).select("positives", "negatives", F.col("roc_auc").between(0.5, 1.0).alias("auc_in_range"))


@query("churn_predictions_check")
def q_churn_predictions_check(spark, sf_dir):
    p = F.col("churn_probability")
    return q_churn_predictions(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("customer_id").alias("customers"),
        F.sum("total_transactions").cast("bigint").alias("transactions"),
        *_violations(bad_probability=p.between(0.0, 1.0), bad_prediction=F.col("prediction") == (p > 0.5).cast("int")))


# ------------------------------------------------- attributions


def _attributions(spark, sf_dir):
    frame, model = _fitted(spark, sf_dir)
    return materialize(A.tree_attributions(model, frame))


@query("tree_attributions")
def q_tree_attributions(spark, sf_dir):
    return _attributions(spark, sf_dir)


@query("attribution_importance")
def q_attribution_importance(spark, sf_dir):
    return A.attribution_importance(_attributions(spark, sf_dir))


@query("attribution_summary")
def q_attribution_summary(spark, sf_dir):
    return A.attribution_summary(_attributions(spark, sf_dir))


@query("tree_attributions_check")
def q_tree_attributions_check(spark, sf_dir):
    """Attributions plus the expected value add up to the model's margin."""
    frame, model = _fitted(spark, sf_dir)
    per = A.tree_attributions(model, frame).groupBy("customer_id").agg(
        (F.sum("attribution") + F.first("expected_value")).alias("made"), F.count_distinct("feature").alias("features"))
    margin = model.transform(frame).select("customer_id", vector_to_array("rawPrediction")[1].alias("margin"))
    # a row a customer on both sides, so never a broadcast
    return per.join(margin.hint("merge"), "customer_id").agg(
        F.count(F.lit(1)).alias("customers"),
        *_violations(bad_sum=F.abs(F.col("made") - F.col("margin")) < 1e-8, bad_features=F.col("features") == 12))


@query("attribution_summary_check")
def q_attribution_summary_check(spark, sf_dir):
    attr = _attributions(spark, sf_dir)                      # written once for both
    one, two = A.attribution_summary(attr), A.attribution_importance(attr)
    both = one.join(two.select("feature", F.col("mean_abs_attribution").alias("other")), "feature")
    ordered = (F.col("min_attribution") <= F.col("p05")) & (F.col("p05") <= F.col("p50")) & (
        F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("max_attribution"))
    return both.select("feature", ordered.alias("ordered"), (F.abs(F.col("other") - F.col("mean_abs_attribution")) < 1e-9).alias("same_mean"))


# ------------------------------------------------------- sources (A)


def _scratch(spark, name):
    path = scratch_path(spark, name)
    track(spark, path)
    return path


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    """A1: the orders as a transaction CSV, read by the CSV reader."""
    tx = _tx(spark, sf_dir)
    cols = [(F.col(f.name) if f.name in tx.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TRANSACTIONS.fields]
    path = S.write_result(tx.select(*cols), _scratch(spark, "csv"), "csv")
    return S.read_transactions(spark, path).select(
        "transaction_id", "customer_id", "transaction_date", "order_value", "quantity", "channel", "discount_used_pct")


@query("table_roundtrip")
def q_table_roundtrip(spark, sf_dir):
    """A2, A3: the month-partitioned table, loaded again."""
    path = _scratch(spark, "table")
    S.write_transactions(_tx(spark, sf_dir), path)
    return S.load_transactions(spark, path)


@query("replaced_table")
def q_replaced_table(spark, sf_dir):
    """A2-A4: a table replaced twice; what the writing job counted and what the current version holds."""
    path, tx = _scratch(spark, "replaced"), _tx(spark, sf_dir)
    TB.replace_table(tx.where(F.col("channel").isNull()), path)
    told = TB.replace_table(tx, path)
    now = TB.load_table(spark, path)
    return now.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(told.rows).cast("bigint").alias("written"),
        F.lit(told.nulls["quantity"]).cast("bigint").alias("null_quantity"), F.lit(told.nulls["customer_id"]).cast("bigint").alias("null_customer"),
        F.lit(told.non_positive["order_value"]).cast("bigint").alias("low_value"), F.lit(told.first).alias("first"), F.lit(told.last).alias("last"))


@query("bucketed_rfm")
def q_bucketed_rfm(spark, sf_dir):
    """RFM over a table bucketed by customer, without an exchange."""
    name = f"custlytics_tx_{uuid.uuid4().hex[:8]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return R.rfm(TB.write_by_customer(_tx(spark, sf_dir), name, buckets, _scratch(spark, "bucketed")), sort=False)


MONTH_RANGES = ((None, None), ("1996-01", "1996-12"), ("1995-03", "1998-02"), ("2001-08", "2001-08"))


@query("customers_by_range")
def q_customers_by_range(spark, sf_dir):
    """Distinct customers of month ranges from monthly sketches, against the exact count."""
    tx = _tx(spark, sf_dir, lines=False)
    sketches = materialize(TB.customer_sketches(tx))
    month = F.date_format("transaction_date", "yyyy-MM")
    out = None
    for i, (first, last) in enumerate(MONTH_RANGES):
        inside = (month >= first if first else F.lit(True)) & (month <= last if last else F.lit(True))
        exact = tx.where(inside).agg(F.count_distinct("customer_id").alias("exact"))
        one = exact.join(F.broadcast(TB.customers_between(sketches, first, last)), F.lit(True)).select(   # one row each
            F.lit(i).alias("range"), "exact", "rows", TB.within_error(F.col("customers"), F.col("exact")).alias("within_error"))
        out = one if out is None else out.unionByName(one)
    return out


@query("result_roundtrip")
def q_result_roundtrip(spark, sf_dir):
    """A result as CSV, reloaded with its types."""
    out = R.rfm(_tx(spark, sf_dir, lines=False), sort=False)
    return S.read_result(spark, S.write_result(out, _scratch(spark, "result"), "csv"), out.schema, "csv")


@query("report_batch")
def q_report_batch(spark, sf_dir):
    """Every row of every report of a batch, as text, from what was written."""
    paths = S.run_reports(spark, _tx(spark, sf_dir), _scratch(spark, "reports"))
    out = None
    for name, path in paths.items():
        df = S.read_result(spark, path)
        cells = F.concat_ws("|", *[F.coalesce(_as_text(F.col(c), t), F.lit("-")) for c, t in df.dtypes])
        one = df.select(F.lit(name).alias("report"), cells.alias("row"))
        out = one if out is None else out.unionByName(one)
    return out


def _as_text(c, kind):
    """A value as text that every engine writes alike: numbers with six decimals."""
    return (c.cast("decimal(30,6)") if kind in ("double", "float") else c).cast("string")


@query("view_export_roundtrip")
def q_view_export_roundtrip(spark, sf_dir):
    """The filtered customers, guarded against an empty selection, as CSV and back."""
    view = V.require_rows(V.filter_customers(_pred(spark, sf_dir, stored=True), **VIEW_FILTER))
    return S.read_result(spark, S.export_view(view, _scratch(spark, "view")), view.schema, "csv")



@query("tx_scan")
def q_tx_scan(spark, sf_dir):
    return _tx(spark, sf_dir)


@query("tx_profile")
def q_tx_profile(spark, sf_dir):
    return S.profile_frame(_tx(spark, sf_dir))


# ----------------------------------- purchase events (timestamps with times)

@query("rfm_events")
def q_rfm_events(spark, sf_dir):
    return R.rfm(TD.purchase_events(spark, sf_dir))


@query("event_churn")
def q_event_churn(spark, sf_dir):
    # one month of events: a one-day inactivity window instead of 90 days
    return E.customer_churn(TD.purchase_events(spark, sf_dir), inactivity_days=1)


@query("dq_suite_events")
def q_dq_suite_events(spark, sf_dir):
    return Q.run_validation(TD.purchase_events(spark, sf_dir))


@query("model_base_join")
def q_model_base_join(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    churn = E.customer_churn(tx, sort=False)
    rfm = R.rfm(tx, sort=False)
    return E.model_base(churn, rfm, R.score_customers(rfm))


@query("rfm_fixed_as_of")
def q_rfm_fixed_as_of(spark, sf_dir):
    # recency anchored to a fixed report date instead of the dataset end
    return R.rfm(_tx(spark, sf_dir, lines=False), as_of="2002-01-01")
