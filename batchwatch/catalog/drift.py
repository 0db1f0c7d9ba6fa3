"""Drift, quality, performance, health and explanation queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import status as St
from ..functions import text as X
from ..operators import categories as C
from ..operators import drift as D
from ..operators import explain as E
from ..operators import health as H
from ..operators import history as Hi
from ..operators import ks as K
from ..operators import performance as P
from ..operators import profile as Pr
from ..operators import quality as Qu
from ..operators.longform import numeric_long
from ..operators.train import score_with_rule
from ..plans import fleet as Fl
from ..plans.alerting import raise_alerts
from ..plans.monitor import profile_baseline, run_monitoring
from ..sources.sinks import persist_runs, read_children, read_runs
from ..storage import materialise, scratch
from . import bindings as B
from . import sql as Q
from .bindings import rounded

KEY = ["batch_id"]
_NUM, _CAT = B.EVENTS_NUMERIC, B.EVENTS_CATEGORICAL
_MEASURES = ("test_statistic", "p_value", "psi", "jsd")


# ── pieces shared by several queries ───────────────────────────────────────────────────────────
def _category_state(spark, sf):
    return materialise(D.category_state(B.events_drifted(spark, sf), _CAT, KEY), "category-state")


def _counts(spark, sf):
    """Present categories of the drifted batches and the baseline's frequencies."""
    state = _category_state(spark, sf)
    return state.filter(F.col("category").isNotNull()), B.category_profile(B.events_baseline(spark, sf), _CAT)


def _ks(batches, base, features):
    return K.ks_statistic(batches, B.reference(base, features), features, KEY)


def _numeric(spark, sf):
    base, batches = B.events_baseline(spark, sf), B.events_drifted(spark, sf)
    profile = B.numeric_profile(base, _NUM)
    state = D.numeric_state(batches, profile, _NUM, KEY)
    return D.numeric_drift(state, profile, _ks(batches, base, _NUM), KEY), state, profile


def _categorical(spark, sf):
    state = _category_state(spark, sf)
    base = B.category_profile(B.events_baseline(spark, sf), _CAT)
    return D.categorical_drift(state, base, KEY), state, base


def _all(spark, sf):
    return _numeric(spark, sf)[0].unionByName(_categorical(spark, sf)[0])


# ── single measures ────────────────────────────────────────────────────────────────────────────
def _lines_divergence(spark, sf):
    base = B.numeric_profile(B.lines_baseline(spark, sf), B.LINES_NUMERIC)
    long = numeric_long(B.lines_batches(spark, sf), B.LINES_NUMERIC, KEY)
    counts = Pr.bin_counts(long, KEY, base.select("feature", "bin_edges"))
    return counts.join(base.select("feature", F.col("bin_counts").alias("base")), "feature")


def psi(spark, sf):
    from ..functions.divergence import psi as measure
    return rounded(_lines_divergence(spark, sf).select(
        "batch_id", "feature", measure("base", "bin_counts").alias("psi")), "psi")


def jsd(spark, sf):
    counts, base = _counts(spark, sf)
    return rounded(C.category_divergence(counts, base, KEY).select("batch_id", "feature", "psi", "jsd"), "psi", "jsd")


def ks_statistic(spark, sf):
    out = _ks(B.lines_batches(spark, sf), B.lines_baseline(spark, sf), B.LINES_NUMERIC)
    return rounded(out.select("batch_id", "feature", "ks", "n_reference", "n_current"), "ks")


def ks_pvalue(spark, sf):
    out = _ks(B.events_drifted(spark, sf), B.events_baseline(spark, sf), _NUM)
    return rounded(out.select("batch_id", "feature", "ks", "p_value"), "ks", "p_value")


def chi_square(spark, sf):
    counts, base = _counts(spark, sf)
    return rounded(C.chi_square(counts, base, KEY).select("batch_id", "feature", "chi2", "p_value"), "chi2", "p_value")


def sparse_merge(spark, sf):
    counts, base = _counts(spark, sf)
    return C.chi_square(counts, base, KEY).select("batch_id", "feature", "columns", "n_current")


def unseen(spark, sf):
    return C.unseen_categories(*_counts(spark, sf), KEY)


def category_alignment(spark, sf):
    counts, base = _counts(spark, sf)
    return C.aligned_categories(counts, base, KEY)


def profile_join(spark, sf):
    base = B.events_baseline(spark, sf)
    batches = B.events_batches(spark, sf).drop("props")
    index = B.reference(base, _NUM)
    profile, counts = B.profiled(base, _NUM, _CAT, index)
    out = D.drift_report(batches, profile, counts, index, _NUM, _CAT, KEY)
    return out.select("batch_id", "feature", "feature_type", "test_name",
                      F.round("psi", 6).alias("psi"), "status")


def drift_numeric(spark, sf):
    return rounded(_numeric(spark, sf)[0], *_MEASURES)


def drift_categorical(spark, sf):
    return rounded(_categorical(spark, sf)[0], *_MEASURES)


def drift_report(spark, sf):
    return rounded(_all(spark, sf).withColumn("severity", D.severity_order()), *_MEASURES)


def drift_lines(spark, sf):
    """The drift report on lineitem: six yearly batches, six features, against the first year."""
    base, batches = B.lines_baseline(spark, sf), B.lines_batches(spark, sf)
    index = B.reference(base, B.LINES_NUMERIC)
    profile, counts = B.profiled(base, B.LINES_NUMERIC, B.LINES_CATEGORICAL, index)
    out = D.drift_report(batches, profile, counts, index, B.LINES_NUMERIC, B.LINES_CATEGORICAL, KEY)
    return rounded(out, *_MEASURES)


def status_counts(spark, sf):
    return D.status_counts(_all(spark, sf), KEY)


def drift_rollup(spark, sf):
    return D.drift_rollup(_all(spark, sf), KEY)


def worst_first(spark, sf):
    return rounded(D.worst_first(B.feature_results(spark, sf)).withColumn(
        "severity", D.severity_order()).select("run_id", "feature", "status", "psi", "severity"), "psi")


# ── scalar rules over history columns ──────────────────────────────────────────────────────────
def band(spark, sf):
    psi_col = F.col("l_discount") * 3
    jsd_col = F.col("l_tax") * 3
    lines = B.table(spark, sf, "lineitem")
    t = St.literal_thresholds()
    a = St.band(psi_col, t["psi_moderate"], t["psi_high"])
    b = St.band(jsd_col, t["jsd_moderate"], t["jsd_high"])
    return lines.select("l_discount", "l_tax", a.alias("psi_band"), b.alias("jsd_band"),
                        St.worst_status(a, b).alias("worst"), St.downgrade(St.worst_status(a, b)).alias("downgraded")
                        ).groupBy("l_discount", "l_tax", "psi_band", "jsd_band", "worst", "downgraded").agg(
        F.count("*").alias("n"))


def classify_feature(spark, sf):
    lines = B.table(spark, sf, "lineitem")
    status = St.classify_feature(
        F.col("l_discount") * 3, F.col("l_tax") * 3, F.col("l_tax"), F.col("l_quantity"),
        F.col("l_quantity") + 5, St.literal_thresholds())
    return lines.select("l_linenumber", status.alias("status")).groupBy("l_linenumber", "status").agg(
        F.count("*").alias("n"))


# ── quality ────────────────────────────────────────────────────────────────────────────────────
def _quality_columns(spark, sf):
    batches, base = B.events_drifted(spark, sf), B.events_baseline(spark, sf)
    profile, counts = B.profiled(base, _NUM, _CAT)
    num = Qu.numeric_quality(D.numeric_state(batches, profile, _NUM, KEY), KEY)
    return num.unionByName(Qu.categorical_quality(_category_state(spark, sf), counts, KEY))


def missing_rates(spark, sf):
    return _quality_columns(spark, sf).select("batch_id", "feature", "rows", "missing", "missing_pct")


def out_of_range(spark, sf):
    return _quality_columns(spark, sf).filter("type = 'NUMERIC'").select(
        "batch_id", "feature", "below_min", "above_max", "out_of_range", "out_of_range_pct")


def iqr_outliers(spark, sf):
    return _quality_columns(spark, sf).filter("type = 'NUMERIC'").select(
        "batch_id", "feature", "outliers", "outlier_pct")


def _redelivered(spark, sf):
    """Later days with part of their events delivered twice, as a double-sending feed does."""
    batches = B.events_drifted(spark, sf).drop("event_id", "ts")
    return batches.unionByName(batches.filter("event_type IN ('view', 'refund')"))


def duplicate_rows(spark, sf):
    return Qu.duplicate_rows(_redelivered(spark, sf), KEY)


def _mistyped(spark, sf):
    """The drifted days with their numbers as text, which later does not always parse."""
    return B.events_drifted(spark, sf).withColumn("value", F.when(
        (F.col("batch_id") >= "2024-01-26") & (F.col("event_type") == "view"), F.lit("12 USD"))
        .otherwise(F.col("value").cast("string")))


def type_mismatch(spark, sf):
    text = _mistyped(spark, sf)
    profile = B.numeric_profile(B.events_baseline(spark, sf), _NUM)
    kinds = Qu.static_mismatches(text, {"value": "numeric"})
    columns = Qu.numeric_quality(D.numeric_state(text, profile, _NUM, KEY), KEY, kinds)
    return Qu.type_mismatches(columns, kinds).select("batch_id", "feature", "expected", "actual")


def _quality_report(spark, sf):
    return Qu.quality_report(_quality_columns(spark, sf), Qu.duplicate_rows(B.events_drifted(spark, sf), KEY), KEY)


def quality_score(spark, sf):
    """All five penalties: the numbers arrive as text."""
    text, base = _mistyped(spark, sf), B.events_baseline(spark, sf)
    profile, counts = B.profiled(base, _NUM, _CAT)
    kinds = Qu.static_mismatches(text, {"value": "numeric", "event_type": "text", "props": "text"})
    state = materialise(D.category_state(text, _CAT, KEY), "category-state")
    columns = Qu.numeric_quality(D.numeric_state(text, profile, _NUM, KEY), KEY, kinds).unionByName(
        Qu.categorical_quality(state, counts, KEY, kinds))
    return Qu.quality_report(columns, Qu.duplicate_rows(text, KEY), KEY)


def problem_columns(spark, sf):
    return Qu.problem_columns(_quality_columns(spark, sf)).select(
        "batch_id", "feature", "type", "missing_pct", F.array_join("issues", "; ").alias("issues"))


def quality_checks(spark, sf):
    limits = {k: S.THRESHOLDS[k] for k in (
        "missing_value_rate_threshold", "duplicate_row_rate_threshold", "outlier_rate_threshold")}
    report = _quality_report(spark, sf).withColumns({k: F.lit(v) for k, v in limits.items()})
    return Hi.quality_checks(report, KEY)


# ── performance ────────────────────────────────────────────────────────────────────────────────
def _outcomes(spark, sf):
    return P.outcome_counts(B.scored_documents(spark, sf), KEY, "y_true", "y_pred")


def score_batch(spark, sf):
    scored = score_with_rule(B.table(spark, sf, "documents"), F.expr(B.PREDICTION_RULE))
    return scored.select("doc_id", "prediction_label")


def prediction_distribution(spark, sf):
    return rounded(P.prediction_distribution(_outcomes(spark, sf), KEY, [*B.CLASSES, "2"]), "share")


def confusion_matrix(spark, sf):
    return P.confusion_matrix(_outcomes(spark, sf), KEY, B.CLASSES)


def confusion_rows(spark, sf):
    matrix = P.confusion_matrix(_outcomes(spark, sf), KEY, B.CLASSES)
    index = F.array_position(F.array(*[F.lit(c) for c in B.CLASSES]), F.col("y_true")) - 1
    return matrix.select("batch_id", F.col("y_true").alias("label"), "y_pred", "n",
                         index.alias("correct_at"), (F.col("y_true") == F.col("y_pred")).alias("diagonal"))


def accuracy_error(spark, sf):
    return rounded(P.accuracy(_outcomes(spark, sf), KEY), "accuracy", "error_rate")


def _class_metrics(spark, sf):
    return P.class_metrics(P.class_totals(_outcomes(spark, sf), KEY, B.CLASSES))


def macro_metrics(spark, sf):
    return rounded(P.macro_metrics(_class_metrics(spark, sf), KEY), "precision_macro", "recall_macro", "f1_macro")


def positive_class_metrics(spark, sf):
    return rounded(P.positive_metrics(_class_metrics(spark, sf), KEY, B.POSITIVE),
                   "precision_positive", "recall_positive", "f1_positive")


def performance_block(spark, sf):
    block = P.performance_block(_outcomes(spark, sf), KEY, B.CLASSES, B.POSITIVE)
    return rounded(block, "accuracy", "error_rate", "precision_macro", "recall_macro", "f1_macro",
                   "precision_positive", "recall_positive", "f1_positive")


def prediction_gate(spark, sf):
    docs = score_with_rule(B.table(spark, sf, "documents"), F.expr(B.PREDICTION_RULE))
    counts = docs.groupBy(F.col("prediction_label").alias("y_pred")).agg(F.count("*").alias("n"))
    classes = B.table(spark, sf, "labels").select(F.col("quality").cast("string").alias("y_pred")).distinct()
    return P.prediction_gate(counts, classes, B.table(spark, sf, "documents").count())


def baseline_prediction_mix(spark, sf):
    from ..operators.train import baseline_prediction_mix as mix
    return rounded(mix(score_with_rule(B.table(spark, sf, "documents"), F.expr(B.PREDICTION_RULE))), "share")


def holdout_evaluation(spark, sf):
    from ..operators.train import holdout_metrics
    scored = B.scored_documents(spark, sf).withColumnRenamed("y_pred", "prediction_label")
    return rounded(holdout_metrics(scored, "y_true", B.POSITIVE), "accuracy", "precision", "recall", "f1")


# ── health ─────────────────────────────────────────────────────────────────────────────────────
def stability(spark, sf):
    counts = _outcomes(spark, sf)
    base = counts.groupBy("y_pred").agg(F.sum("n").alias("n"))
    out = H.mix_divergence(counts, base, KEY)
    return rounded(out.withColumn("stability", St.stability_component(F.col("mix_jsd"))), "mix_jsd", "stability")


def _health_inputs(spark, sf):
    runs = B.runs(spark, sf).filter("status = 'COMPLETED'")
    reference = Hi.reference_accuracy(B.versions(spark, sf), B.runs(spark, sf))
    return runs.drop("health_score", "health_band").join(reference, "version_id").withColumn(
        "mix_jsd", F.col("recall_macro") / 4)


def health_score(spark, sf):
    out = H.health_score(_health_inputs(spark, sf)).select(
        "run_id", "health_performance", "health_drift", "health_quality", "health_stability",
        "weighting", "health_raw_score", "health_score", "health_capped", "health_band")
    return rounded(out, "health_performance", "health_drift", "health_quality", "health_stability")


def health_breakdown(spark, sf):
    return H.health_breakdown(H.health_score(_health_inputs(spark, sf)), ["run_id"])


# ── explanations ───────────────────────────────────────────────────────────────────────────────
def explain_numeric(spark, sf):
    drift, state, profile = _numeric(spark, sf)
    return E.explain_numeric(drift, state, profile, KEY).select("batch_id", "feature", "status", "explanation")


def explain_categorical(spark, sf):
    drift, state, base = _categorical(spark, sf)
    drift = materialise(drift, "categorical-drift")
    gone = C.unseen_categories(state.filter(F.col("category").isNotNull()), base, KEY)
    return E.explain_categorical(drift, state, base, gone, KEY).select(
        "batch_id", "feature", "status", "explanation")


def explain(spark, sf):
    absent = D.absent_features(
        B.events_batches(spark, sf).select("batch_id").distinct(), [("gone", S.NUMERIC)], KEY)
    return explain_numeric(spark, sf).unionByName(explain_categorical(spark, sf)).unionByName(
        E.explain_absent(absent).select("batch_id", "feature", "status", "explanation"))


def driving_measure(spark, sf):
    t = St.literal_thresholds()
    return B.feature_results(spark, sf).select(
        "run_id", "feature", "line_key", E.driving_measure(F.col("psi"), F.col("jsd"), t).alias("driver")
    ).filter(F.col("driver").isNotNull())


def significance_clause(spark, sf):
    p = F.when(F.col("l_linenumber") < 7, F.col("l_tax"))
    test = F.when(F.col("l_returnflag") == "R", "KS").otherwise("CHI2")
    return B.table(spark, sf, "lineitem").select(E.significance_clause(p, test).alias("clause")).groupBy(
        "clause").agg(F.count("*").alias("n"))


def top_movers(spark, sf):
    counts, base = _counts(spark, sf)
    return rounded(E.top_movers(counts, base, KEY), "before", "after", "delta")


def first_k_values(spark, sf):
    counts, base = _counts(spark, sf)
    out = E.first_unseen(C.unseen_categories(counts, base, KEY), KEY)
    return out.withColumn("first_values", F.array_join("first_values", ","))


def format_number_pct_p(spark, sf):
    lines = B.table(spark, sf, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.number(F.col("l_extendedprice")).alias("price"),
        X.percent(F.col("l_quantity")).alias("share"), X.p_value(F.col("l_discount") / 70).alias("p"))


def display_filters(spark, sf):
    results = B.feature_results(spark, sf)
    badge = X.badge(F.col("status"))
    return results.select(
        "run_id", "feature", "line_key", X.bare_p_value(F.col("p_value")).alias("p"),
        X.test_label(F.when(F.col("feature_type") == "R", "KS").when(F.col("feature_type") == "A", "CHI2")).alias("test"),
        X.ratio_percent(F.col("psi")).alias("ratio"), X.percent(F.col("test_statistic")).alias("pct"),
        X.words(F.lit("with_labels")).alias("words"), badge["tone"].alias("tone"),
        badge["icon"].alias("icon"), badge["label"].alias("label"))


def bin_labels(spark, sf):
    profile = B.numeric_profile(B.lines_baseline(spark, sf), B.LINES_NUMERIC)
    return profile.select("feature", F.posexplode(X.bin_labels(F.col("bin_edges"))).alias("bin", "label"))


def summary_rows(spark, sf):
    base = Pr.numeric_summary(numeric_long(B.lines_baseline(spark, sf), B.LINES_NUMERIC, []), ["feature"])
    cur = Pr.numeric_summary(numeric_long(B.lines_batches(spark, sf), B.LINES_NUMERIC, KEY), [*KEY, "feature"])
    return rounded(Hi.summary_rows(base, cur, KEY, True), "baseline", "current")


def distribution_compare(spark, sf):
    return Hi.compare_categories(category_alignment(spark, sf), KEY)


def distribution_compare_bins(spark, sf):
    profile = B.numeric_profile(B.lines_baseline(spark, sf), B.LINES_NUMERIC)
    state = D.numeric_state(B.lines_batches(spark, sf), profile, B.LINES_NUMERIC, KEY)
    return Hi.compare_bins(profile, state, KEY)


# ── whole runs ─────────────────────────────────────────────────────────────────────────────────
_RUN_RULE = "CASE WHEN props > '{\"k\": 5' THEN 'error' ELSE 'view' END"


def _monitored(spark, sf, thresholds=None):
    base = profile_baseline(B.events_baseline(spark, sf), _NUM, _CAT)
    mix = B.events_baseline(spark, sf).select(F.expr(_RUN_RULE).alias("y_pred")).groupBy("y_pred").agg(
        F.count("*").alias("n"))
    return run_monitoring(
        B.events_drifted(spark, sf), base, KEY, F.expr(_RUN_RULE), target="event_type",
        labels=["error", "view"], positive="error", baseline_mix=mix, reference_accuracy=0.3, thresholds=thresholds)


_RUN_COLUMNS = ["batch_id", "row_count", "quality_score", "features_total", "features_high",
                "features_moderate", "features_insufficient", "drift_status", "accuracy", "mix_jsd",
                "health_raw_score", "health_score", "health_band", "weighting"]


def run_monitoring_query(spark, sf):
    return rounded(_monitored(spark, sf).runs.select(*_RUN_COLUMNS), "accuracy", "mix_jsd")


def persist_run(spark, sf):
    root = scratch(spark, "history")
    persist_runs(_monitored(spark, sf).tables(), root, "1")
    counts = read_children(spark, root, "feature_results").groupBy("batch_id").agg(
        F.count("*").alias("stored_features"))
    runs = read_runs(spark, root).join(counts, "batch_id")
    return rounded(runs.select(*_RUN_COLUMNS, "stored_features"), "accuracy", "mix_jsd")


# two models with tables, classes and limits of their own, in one job
_FLEET_LIMITS = (0.02, 0.05, 0.02, 0.04)


def _fleet(spark, sf):
    events, lines = [*_NUM, *_CAT], [*B.LINES_NUMERIC, *B.LINES_CATEGORICAL]
    scored = B.events_drifted(spark, sf).withColumn("y_pred", F.expr(_RUN_RULE)).withColumn("y_true", F.col("event_type"))
    base = B.events_baseline(spark, sf)
    rows = Fl.long_rows(scored, "events", "batch_id", ["event_id"], [*events, "ts", "user_id", "y_pred", "y_true"]).unionByName(
        Fl.long_rows(B.lines_batches(spark, sf), "lines", "batch_id", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                                        "l_shipdate"], [*lines, *B.LINES_KEY[:4]]))
    history = Fl.long_rows(base, "events", "'base'", ["event_id"], events).unionByName(Fl.long_rows(
        B.lines_baseline(spark, sf), "lines", "'base'", ["l_orderkey", "l_linenumber"], lines))
    roles = spark.createDataFrame(
        [("events", c, S.NUMERIC) for c in _NUM] + [("events", c, S.CATEGORICAL) for c in _CAT]
        + [("lines", c, S.NUMERIC) for c in B.LINES_NUMERIC] + [("lines", c, S.CATEGORICAL) for c in B.LINES_CATEGORICAL]
        + [("events", "y_true", Fl.TARGET), ("events", "y_pred", Fl.PREDICTION)], "model_id string, column string, role string")
    own = dict(zip(("psi_moderate", "psi_high", "jsd_moderate", "jsd_high"), _FLEET_LIMITS))

    def limits(overrides):
        return F.struct(*[F.lit(float(v)).alias(k) for k, v in {**S.THRESHOLDS, **overrides}.items()])

    models = spark.createDataFrame([("events", ["error", "view"], "error", 0.3), ("lines", [], None, None)],
                                   "model_id string, labels array<string>, positive string, reference_accuracy double")
    models = models.withColumn("thresholds", F.when(F.col("model_id") == "lines", limits(own)).otherwise(limits({})))
    mix = base.select(F.lit("events").alias("model_id"), F.expr(_RUN_RULE).alias("y_pred")).groupBy("model_id", "y_pred").agg(
        F.count("*").alias("n"))
    return Fl.run_fleet(rows, Fl.profile_fleet(history, roles), models, mix)


def fleet_features(spark, sf):
    out = _fleet(spark, sf).feature_results.drop("explanation")
    return rounded(out, "test_statistic", "p_value", "psi", "jsd")


def fleet_runs(spark, sf):
    return rounded(_fleet(spark, sf).runs.select("model_id", *_RUN_COLUMNS), "accuracy", "mix_jsd")


#: two days, so that daily runs can continue an alert; the others make daily runs differ
_ALERT_LIMITS = {"alert_cooldown_minutes": 2880.0, "health_critical_threshold": 55.0}
_HALVES = ("2024-01-20", "9999")


def _alerted(spark, sf):
    """Stored runs of two commits, alerts raised after each; the second commit is run twice."""
    root = scratch(spark, "history")
    tables = {k: materialise(t, k) for k, t in _monitored(spark, sf, _ALERT_LIMITS).tables().items()}
    tables["runs"] = tables["runs"].withColumns({
        "model_id": F.lit(1).cast("long"), "run_id": F.col("batch_id"), "created_at": F.to_timestamp("batch_id")})
    names = spark.createDataFrame([(1, "events")], "model_id long, name string")
    low = ""
    for commit, high in enumerate(_HALVES, 1):
        part = {k: t.where((F.col("batch_id") > low) & (F.col("batch_id") <= high)) for k, t in tables.items()}
        persist_runs(part, root, str(commit))
        for _ in range(commit):
            out = raise_alerts(spark, root, str(commit), KEY, names)
        low = high
    return out


def run_to_alerts(spark, sf):
    return _alerted(spark, sf).alerts.drop("message", "cooldown").withColumn("first_seen_at", F.to_date("first_seen_at")).withColumn(
        "last_seen_at", F.to_date("last_seen_at"))


def run_to_advice(spark, sf):
    return _alerted(spark, sf).advice.select("model_id", "number", "first_run_id", "run_id", "severity", "updates", "status")


def _stored_lines(spark, sf):
    """The folder of a stored run of the yearly lineitem batches."""
    base = profile_baseline(B.lines_baseline(spark, sf), B.LINES_NUMERIC, B.LINES_CATEGORICAL)
    root = scratch(spark, "history")
    persist_runs(run_monitoring(B.lines_batches(spark, sf), base, KEY, F.lit(None)).tables(), root, "1")
    return root


def stored_summary_rows(spark, sf):
    """Both sides of the numeric results, from what a stored run holds."""
    found = read_children(spark, _stored_lines(spark, sf), "feature_summaries").where(F.col("feature").isin(B.LINES_NUMERIC))
    base = found.select("feature", "baseline.*").distinct()
    return rounded(Hi.summary_rows(base, found.select(*KEY, "feature", "current.*"), KEY, True), "baseline", "current")


def stored_bins(spark, sf):
    """Bins of both sides, from what a stored run holds."""
    found = read_children(spark, _stored_lines(spark, sf), "feature_summaries").where(F.col("feature").isin(B.LINES_NUMERIC))
    profile = found.select("feature", "baseline.*").distinct()
    return Hi.compare_bins(profile, found.select(*KEY, "feature", "current.bin_counts"), KEY)


QUERIES = {
    "psi": psi, "jsd": jsd, "ks_statistic": ks_statistic, "ks_pvalue": ks_pvalue, "chi_square": chi_square,
    "sparse_merge": sparse_merge, "unseen_categories": unseen, "category_alignment": category_alignment,
    "profile_join": profile_join, "drift_numeric_features": drift_numeric,
    "drift_categorical_features": drift_categorical, "drift_report": drift_report,
    "drift_report_lineitem": drift_lines, "status_counts": status_counts, "drift_rollup": drift_rollup,
    "worst_first": worst_first, "band": band, "classify_feature": classify_feature,
    "missing_rates": missing_rates, "out_of_range": out_of_range, "iqr_outliers": iqr_outliers,
    "duplicate_rows": duplicate_rows, "type_mismatch": type_mismatch, "quality_score": quality_score,
    "problem_columns": problem_columns, "quality_checks": quality_checks, "score_batch": score_batch,
    "prediction_distribution": prediction_distribution, "confusion_matrix": confusion_matrix,
    "confusion_rows": confusion_rows, "accuracy_error": accuracy_error, "macro_metrics": macro_metrics,
    "positive_class_metrics": positive_class_metrics, "performance_block": performance_block,
    "prediction_gate": prediction_gate, "baseline_prediction_mix": baseline_prediction_mix,
    "holdout_evaluation": holdout_evaluation, "stability_component": stability,
    "health_score": health_score, "health_breakdown": health_breakdown, "explain_numeric": explain_numeric,
    "explain_categorical": explain_categorical, "explain": explain, "driving_measure": driving_measure,
    "significance_clause": significance_clause, "top_movers": top_movers, "first_k_values": first_k_values,
    "format_number_pct_p": format_number_pct_p, "display_filters": display_filters, "bin_labels": bin_labels,
    "summary_rows": summary_rows, "distribution_compare": distribution_compare,
    "distribution_compare_bins": distribution_compare_bins, "run_monitoring": run_monitoring_query,
    "persist_run": persist_run, "run_to_alerts": run_to_alerts, "run_to_advice": run_to_advice, "fleet_features": fleet_features, "fleet_runs": fleet_runs,
    "stored_summary_rows": stored_summary_rows, "stored_bins": stored_bins,
}


# ── the same in SQL ────────────────────────────────────────────────────────────────────────────
_EVENTS_NUM = [B.EVENTS_DRIFTED_SQL, *Q.numeric_drift(_NUM)]
_EVENTS_CAT = [B.EVENTS_DRIFTED_SQL, *Q.categorical_drift(_CAT)]
_EVENTS_ALL = [B.EVENTS_DRIFTED_SQL, *Q.drift(_NUM, _CAT)]
_ROW = "event_id, ts, user_id, event_type, value, props"
_EVENTS_QUALITY = [*_EVENTS_ALL, *Q.quality(_NUM, _CAT, _ROW)]
# numbers as text: what does not parse counts neither as a number nor as missing
_TEXT_QUALITY = [B.EVENTS_DRIFTED_SQL.replace("batch AS (SELECT", "batch0 AS (SELECT"), """batch AS (SELECT * REPLACE (
  CASE WHEN batch_id >= '2024-01-26' AND event_type = 'view' THEN NULL ELSE value END AS value) FROM batch0)""",
                 *Q.drift(_NUM, _CAT), *Q.quality(_NUM, _CAT, _ROW),
                 """tx AS (SELECT batch_id, count(*) FILTER (batch_id >= '2024-01-26' AND event_type = 'view') AS t FROM batch0 GROUP BY batch_id)""",
                 """tq AS (SELECT batch_id, row_count, duplicate_rows, columns_checked, missing_total - t AS missing_total, cells, nums,
  outlier_total, unseen_columns, CAST(t > 0 AS BIGINT) AS mismatch_columns FROM dup JOIN qp USING (batch_id) JOIN tx USING (batch_id))"""]
_LINES_NUM = [B.LINES_SQL, *Q.numeric_drift(B.LINES_NUMERIC)]
_DRIFT_COLUMNS = """batch_id, feature, feature_type, test_name, round(stat, 6) AS test_statistic, round(p, 6) AS p_value,
  round(psi, 6) AS psi, round(jsd, 6) AS jsd, n0 AS n_baseline, n1 AS n_current, n_unseen, status"""
_RANK = "CASE status WHEN 'HIGH' THEN 0 WHEN 'MODERATE' THEN 1 WHEN 'NONE' THEN 2 ELSE 3 END"

# classifier metrics from counts
_PERF = [B.SCORED_SQL, """oc AS (SELECT batch_id, y_true, y_pred, count(*) AS n FROM scored GROUP BY batch_id, y_true, y_pred)""",
         """lab AS (SELECT * FROM oc WHERE y_true IS NOT NULL)""",
         """grid AS (SELECT DISTINCT batch_id, label FROM lab, (VALUES ('0'), ('1')) l(label))""",
         """ct AS (SELECT g.batch_id, g.label, coalesce(sum(n) FILTER (y_true = g.label), 0) AS support,
  coalesce(sum(n) FILTER (y_pred = g.label), 0) AS predicted,
  coalesce(sum(n) FILTER (y_true = g.label AND y_pred = g.label), 0) AS tp
  FROM grid g JOIN lab USING (batch_id) GROUP BY g.batch_id, g.label)""",
         """cm AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall,
  coalesce(2 * tp / nullif(predicted + support, 0), 0.0) AS f1 FROM ct)""",
         """acc AS (SELECT batch_id, coalesce(sum(n) FILTER (y_true = y_pred), 0) AS hits, sum(n) AS sample_count FROM lab GROUP BY batch_id)""",
         """mac AS (SELECT batch_id, avg(precision) AS pm, avg(recall) AS rm, avg(f1) AS fm FROM cm GROUP BY batch_id)""",
         """pos AS (SELECT batch_id, precision AS pp, recall AS rp, f1 AS fp FROM cm WHERE label = '1')"""]

# health of the run history
_REFERENCE = """refacc AS (SELECT v.version_id, coalesce(v.training_accuracy, f.accuracy) AS reference_accuracy
  FROM versions v LEFT JOIN (SELECT version_id, min_by(accuracy, (created_at, run_id)) AS accuracy
    FROM runs WHERE labels_available GROUP BY version_id) f USING (version_id))"""
_HEALTH = [B.RUNS_SQL, B.VERSIONS_SQL, _REFERENCE,
           """hp AS (SELECT run_id, drift_status, CASE WHEN accuracy IS NULL THEN NULL WHEN reference_accuracy IS NULL THEN 100.0
  ELSE greatest(0.0, least(100.0, 100 - 200 * greatest(0.0, reference_accuracy - accuracy))) END AS perf,
  greatest(0.0, least(100.0, 100.0 - 15.0 * features_high - 6.0 * features_moderate)) AS drift,
  CAST(greatest(0, least(100, quality_score)) AS DOUBLE) AS qual,
  CASE WHEN recall_macro IS NULL THEN 100.0 ELSE greatest(0.0, least(100.0, 100 - 200 * (recall_macro / 4))) END AS stab,
  labels_available AND accuracy IS NOT NULL AS labelled
  FROM runs JOIN refacc USING (version_id) WHERE status = 'COMPLETED')""",
           """hr AS (SELECT *, CAST(round_even(CASE WHEN labelled THEN (perf * 40 + drift * 30 + qual * 20 + stab * 10) / 100
  ELSE (drift * 50 + qual * 35 + stab * 15) / 100 END, 0) AS BIGINT) AS raw FROM hp)""",
           "hs AS (SELECT *, CASE WHEN drift_status = 'HIGH' THEN least(raw, 79) ELSE raw END AS score FROM hr)"]

_BANDS = "CASE WHEN score >= 80 THEN 'HEALTHY' WHEN score >= 60 THEN 'WARNING' ELSE 'CRITICAL' END"


def _driver(psi: str, jsd: str) -> str:
    def text(name: str, value: str, level: str, limit: str) -> str:
        return f"concat('{name} is ', format('{{:.3f}}', {value}), ', above the {level}-drift threshold of {limit}')"
    return (f"(CASE WHEN {psi} > 0.25 THEN {text('PSI', psi, 'high', '0.25')} "
            f"WHEN {jsd} > 0.2 THEN {text('JSD', jsd, 'high', '0.20')} "
            f"WHEN {psi} >= 0.1 THEN {text('PSI', psi, 'moderate', '0.10')} "
            f"WHEN {jsd} >= 0.1 THEN {text('JSD', jsd, 'moderate', '0.10')} END)")


def _p_text(p: str) -> str:
    return f"(CASE WHEN {p} IS NULL THEN 'n/a' WHEN {p} < 0.001 THEN 'p < 0.001' ELSE concat('p = ', format('{{:.3f}}', {p})) END)"


def _clause(p: str, ks: str) -> str:
    test = f"CASE WHEN {ks} THEN 'K-S test' ELSE 'Chi-Square test' END"
    return (f"(CASE WHEN {p} IS NULL THEN '' WHEN {p} < 0.05 THEN concat(' The ', {test}, ' returns ', {_p_text(p)}, "
            f"', confirming the two distributions differ.') ELSE concat(' The ', {test}, ' returns ', {_p_text(p)}, "
            "', so the difference is not statistically confirmed at this sample size — the status has been reduced by one level as a precaution.') END)")


def _n(value: str) -> str:
    return f"format('{{:,.2f}}', {value})"


_PHRASE = "CASE status WHEN 'HIGH' THEN 'High drift' WHEN 'MODERATE' THEN 'Moderate drift' END"
_FEW = ("concat('Not enough data to assess `', feature, '`. At least 30 non-empty values are needed on both sides; "
        "this run had ', format('{:,}', n1), ' in the batch.')")
_EXPLAIN_NUM = [*_EVENTS_NUM, """cur AS (SELECT batch_id, feature, avg(v) AS mean1, stddev_pop(v) AS std1,
  round_even(100.0 * (count(*) - count(v)) / count(*), 4) AS missing1 FROM cl GROUP BY batch_id, feature)""",
    f"""en AS (SELECT nd.*, mean0, std0, mean1, std1, missing1, {Q.pct('missing0', 'rows0')} AS missing0
  FROM nd JOIN cur USING (batch_id, feature) JOIN prof USING (feature))""",
    f"""ent AS (SELECT batch_id, feature, status, CASE WHEN status = 'INSUFFICIENT_DATA' THEN {_FEW}
  WHEN status = 'NONE' THEN concat('No drift in `', feature, '`. The average is ', {_n('mean1')}, ' against a baseline of ', {_n('mean0')}, ', within normal variation.')
  ELSE concat({_PHRASE}, ' detected in `', feature, '`. The average ', CASE WHEN mean1 > mean0 THEN 'rose' ELSE 'fell' END,
    ' from ', {_n('mean0')}, ' in the baseline to ', {_n('mean1')}, ' in this batch (',
    CASE WHEN mean1 >= mean0 THEN '+' ELSE '' END, format('{{:.1f}}', 100 * (mean1 - mean0) / abs(mean0)), '%)',
    CASE WHEN std0 <> std1 THEN concat(', and the spread ', CASE WHEN std1 > std0 THEN 'widened' ELSE 'narrowed' END,
      ' (std ', {_n('std0')}, ' → ', {_n('std1')}, ').') ELSE '.' END,
    coalesce(concat(' ', {_driver('psi', 'jsd')} || '.'), ''), {_clause('p', 'true')},
    CASE WHEN missing1 - missing0 > 1 THEN concat(' Missing values also rose from ', format('{{:.1f}}', missing0), '% to ',
      format('{{:.1f}}', missing1), '%.') ELSE '' END) END AS explanation FROM en)"""]
_MOVERS = ["""mv AS (SELECT batch_id, feature, cell, 100.0 * b / n0 AS before, 100.0 * c / n1 AS after,
  100.0 * c / n1 - 100.0 * b / n0 AS delta FROM catcells)""",
           """mr AS (SELECT *, row_number() OVER (PARTITION BY batch_id, feature ORDER BY delta DESC, cell) AS rise,
  row_number() OVER (PARTITION BY batch_id, feature ORDER BY delta, cell) AS fall FROM mv WHERE abs(delta) > 0.5)""",
           """mt AS (SELECT batch_id, feature, cell AS category, 'up' AS direction, rise AS place, before, after, delta FROM mr WHERE delta > 0.5 AND rise <= 2
  UNION ALL SELECT batch_id, feature, cell, 'down', fall, before, after, delta FROM mr WHERE delta < -0.5 AND fall <= 2)"""]
_EXPLAIN_CAT = [*_EVENTS_CAT, *_MOVERS,
    """ms AS (SELECT batch_id, feature, list(concat(CASE WHEN direction = 'up' THEN concat('the share of *', category, '* rose')
    ELSE concat('*', category, '* fell') END, ' from ', format('{:.1f}', before), '% to ', format('{:.1f}', after), '% (',
    CASE WHEN delta >= 0 THEN '+' ELSE '' END, format('{:.1f}', delta), ' points)') ORDER BY direction DESC, place) AS l
  FROM mt GROUP BY batch_id, feature)""",
    """mj AS (SELECT batch_id, feature, concat(upper(l[1][1]), l[1][2:], CASE WHEN len(l) > 1 THEN ' while ' ELSE '' END,
  array_to_string(l[2:], ', '), '.') AS moved FROM ms)""",
    """un AS (SELECT batch_id, feature, list(cell ORDER BY cell) AS u FROM (SELECT batch_id, feature, cell FROM c0 ANTI JOIN b0 USING (feature, cell))
  GROUP BY batch_id, feature)""",
    f"""ect AS (SELECT batch_id, feature, status, CASE WHEN status = 'INSUFFICIENT_DATA' THEN {_FEW}
  WHEN status = 'NONE' THEN concat('No drift in `', feature, '`. Category proportions are close to the baseline across all ', k0, ' categories.')
  ELSE concat({_PHRASE}, ' detected in `', feature, '`.', coalesce(' ' || moved, ''),
    coalesce(' The batch also contains ' || array_to_string(list_transform(u[1:3], lambda x: '*' || x || '*'), ', ')
      || CASE WHEN len(u) > 3 THEN concat(' and ', len(u) - 3, ' more') ELSE '' END || ', which never appeared in the baseline data.', ''),
    coalesce(' ' || {_driver('psi', 'jsd')} || '.', ''), {_clause('p', 'false')}) END AS explanation
  FROM cd JOIN bs USING (feature) LEFT JOIN mj USING (batch_id, feature) LEFT JOIN un USING (batch_id, feature))"""]

_RULE = _RUN_RULE
_RUN_SQL = [*[b for b in (B.EVENTS_DRIFTED_SQL, *Q.drift(_NUM, _CAT))], Q.ROLLUP, *Q.quality(_NUM, _CAT, _ROW),
            f"""sc AS (SELECT batch_id, event_type AS y_true, {_RULE} AS y_pred FROM batch)""",
            """ac AS (SELECT batch_id, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM sc GROUP BY batch_id)""",
            f"""m0 AS (SELECT {_RULE} AS k, count(*) AS n FROM base GROUP BY k)""",
            """m1 AS (SELECT batch_id, y_pred AS k, count(*) AS n FROM sc GROUP BY batch_id, y_pred)""",
            """mixcells AS (SELECT g.batch_id, 'mix' AS feature, g.k AS cell, coalesce(m0.n, 0) AS b, coalesce(m1.n, 0) AS c,
  (SELECT sum(n) FROM m0) AS n0, sum(coalesce(m1.n, 0)) OVER (PARTITION BY g.batch_id) AS n1
  FROM (SELECT DISTINCT batch_id, k FROM m1, (SELECT k FROM m0 UNION SELECT k FROM m1) x(k2) , (SELECT k FROM m0) y(k3)) g
  LEFT JOIN m0 USING (k) LEFT JOIN m1 ON m1.batch_id = g.batch_id AND m1.k = g.k)""",
            Q.divergence("mixcells", "mix"),
            """h1 AS (SELECT batch_id, row_count, quality_score, features_total, features_high, features_moderate,
  features_insufficient, drift_status, accuracy, mix.jsd AS mix_jsd,
  greatest(0.0, least(100.0, 100 - 200 * greatest(0.0, 0.3 - accuracy))) AS perf,
  greatest(0.0, least(100.0, 100.0 - 15.0 * features_high - 6.0 * features_moderate)) AS dc,
  greatest(0.0, least(100.0, 100 - 200 * mix.jsd)) AS stab
  FROM qr JOIN rolled USING (batch_id) JOIN ac USING (batch_id) JOIN mix USING (batch_id))""",
            """h2 AS (SELECT *, CAST(round_even((perf * 40 + dc * 30 + quality_score * 20 + stab * 10) / 100, 0) AS BIGINT) AS raw FROM h1)""",
            """h3 AS (SELECT *, CASE WHEN drift_status = 'HIGH' THEN least(raw, 79) ELSE raw END AS score FROM h2)"""]
_RUN_SELECT = f"""SELECT batch_id, row_count, quality_score, features_total, features_high, features_moderate, features_insufficient,
  drift_status, round(accuracy, 6) AS accuracy, round(mix_jsd, 6) AS mix_jsd, raw AS health_raw_score, score AS health_score,
  {_BANDS} AS health_band, 'with_labels' AS weighting"""
_ALIGNED = [*_EVENTS_CAT, """al AS (SELECT batch_id, feature, cell AS category, b AS n_baseline, c AS n_current FROM catcells)"""]

# alerts of the stored event runs
_ALERTED = [*_RUN_SQL, """rec AS (SELECT batch_id, drift_status, features_high + features_moderate AS drifted, 0.3 - accuracy >= 0.05 AS fell,
  score < 55 AND lag(score) OVER w < 55 AS twice, quality_score < 50 AND lag(quality_score) OVER w < 50 AS poor
  FROM h3 WINDOW w AS (ORDER BY batch_id)),
adv AS (SELECT * FROM rec WHERE drift_status = 'HIGH' OR drifted >= 3 OR fell OR twice OR poor)""",
            """oc AS (SELECT batch_id, 'DRIFT' AS category, feature, CASE status WHEN 'HIGH' THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
    concat('DRIFT_', status) AS rule_code, concat(CASE status WHEN 'HIGH' THEN 'High' ELSE 'Moderate' END, ' drift detected — ', feature) AS headline
  FROM dr WHERE status IN ('HIGH', 'MODERATE')
  UNION ALL SELECT batch_id, 'PERFORMANCE', '', CASE WHEN 0.3 - accuracy >= 0.1 THEN 'CRITICAL' ELSE 'WARNING' END,
    concat('PERFORMANCE_DROP_', CASE WHEN 0.3 - accuracy >= 0.1 THEN 'MAJOR' ELSE 'MINOR' END),
    CASE WHEN 0.3 - accuracy >= 0.1 THEN 'Accuracy has fallen sharply' ELSE 'Accuracy has fallen' END FROM h3 WHERE 0.3 - accuracy >= 0.05
  UNION ALL SELECT batch_id, 'QUALITY', '', CASE WHEN quality_score < 50 THEN 'CRITICAL' ELSE 'WARNING' END,
    CASE WHEN quality_score < 50 THEN 'QUALITY_POOR' ELSE 'QUALITY_DEGRADED' END,
    CASE WHEN quality_score < 50 THEN 'Incoming data quality is poor' ELSE 'Incoming data quality has degraded' END FROM h3 WHERE quality_score < 70
  UNION ALL SELECT batch_id, 'HEALTH', '', CASE WHEN score < 55 THEN 'CRITICAL' ELSE 'WARNING' END,
    CASE WHEN score < 55 THEN 'HEALTH_CRITICAL' ELSE 'HEALTH_WARNING' END,
    CASE WHEN score < 55 THEN 'Model health is critical' ELSE 'Model health has degraded' END FROM h3 WHERE score < 80
  UNION ALL SELECT min(batch_id), 'RETRAIN', '', 'CRITICAL', 'RETRAIN_RECOMMENDED', 'Retraining recommended for events' FROM adv HAVING count(*) > 0),
os AS (SELECT *, CASE WHEN date_diff('day', lag(CAST(batch_id AS DATE)) OVER w, CAST(batch_id AS DATE)) <= 2 THEN 0 ELSE 1 END AS s
  FROM oc WINDOW w AS (PARTITION BY category, feature ORDER BY batch_id)),
oi AS (SELECT *, sum(s) OVER (PARTITION BY category, feature ORDER BY batch_id) AS number FROM os),
last3 AS (SELECT min(score) >= 80 AND count(*) = 3 AS clean FROM (SELECT score FROM h3 ORDER BY batch_id DESC LIMIT 3)),
half3 AS (SELECT min(score) >= 80 AND count(*) = 3 AS clean FROM (SELECT score FROM h3 WHERE batch_id <= '2024-01-20' ORDER BY batch_id DESC LIMIT 3))"""]

# lineitem batches have no outcomes: no performance, stable mix
_LINES_RUN = [B.LINES_SQL, *Q.drift(B.LINES_NUMERIC, B.LINES_CATEGORICAL, _FLEET_LIMITS), Q.ROLLUP,
              *Q.quality(B.LINES_NUMERIC, B.LINES_CATEGORICAL, ", ".join(dict.fromkeys(
                  [*B.LINES_NUMERIC, *B.LINES_CATEGORICAL, *B.LINES_KEY[:4]]))),
              """h1 AS (SELECT batch_id, row_count, quality_score, features_total, features_high, features_moderate,
  features_insufficient, drift_status, CAST(NULL AS DOUBLE) AS accuracy, CAST(NULL AS DOUBLE) AS mix_jsd,
  greatest(0.0, least(100.0, 100.0 - 15.0 * features_high - 6.0 * features_moderate)) AS dc FROM qr JOIN rolled USING (batch_id))""",
              """h2 AS (SELECT *, CAST(round_even((dc * 50 + quality_score * 35 + 100 * 15) / 100, 0) AS BIGINT) AS raw FROM h1)""",
              """h3 AS (SELECT *, CASE WHEN drift_status = 'HIGH' THEN least(raw, 79) ELSE raw END AS score FROM h2)"""]

ORACLES = {
    "run_to_alerts": Q.with_(*_ALERTED) + """SELECT CAST(1 AS BIGINT) AS model_id, category, feature, CAST(number AS BIGINT) AS number,
  arg_max(severity, batch_id) AS severity, arg_max(rule_code, batch_id) AS rule_code, arg_max(headline, batch_id) AS headline,
  max(batch_id) AS run_id, CAST(min(batch_id) AS DATE) AS first_seen_at, CAST(max(batch_id) AS DATE) AS last_seen_at,
  count(*) AS occurrence_count, CASE WHEN category = 'HEALTH' AND ((SELECT clean FROM last3) OR (max(batch_id) <= '2024-01-20'
    AND (SELECT clean FROM half3))) THEN 'RESOLVED' ELSE 'NEW' END AS status
FROM oi GROUP BY category, feature, number""",
    "run_to_advice": Q.with_(*_ALERTED) + """SELECT CAST(1 AS BIGINT) AS model_id, CAST(1 AS BIGINT) AS number, min(batch_id) AS first_run_id,
  max(batch_id) AS run_id, arg_max(CASE WHEN drift_status = 'HIGH' OR fell OR twice
    OR CAST(drifted >= 3 AS INT) + CAST(poor AS INT) >= 2 THEN 'URGENT' ELSE 'ADVISED' END, batch_id) AS severity,
  count(*) AS updates, 'OPEN' AS status FROM adv HAVING count(*) > 0""",
    "fleet_features": f"""SELECT 'events' AS model_id, * FROM ({Q.with_(*_EVENTS_ALL)} SELECT {_DRIFT_COLUMNS} FROM dr)
UNION ALL SELECT 'lines', * FROM ({Q.with_(B.LINES_SQL, *Q.drift(B.LINES_NUMERIC, B.LINES_CATEGORICAL, _FLEET_LIMITS))}
  SELECT {_DRIFT_COLUMNS} FROM dr)""",
    "fleet_runs": f"""SELECT 'events' AS model_id, * FROM ({Q.with_(*_RUN_SQL)} {_RUN_SELECT} FROM h3)
UNION ALL SELECT 'lines', * FROM ({Q.with_(*_LINES_RUN)} {_RUN_SELECT.replace("'with_labels'", "'without_labels'")} FROM h3)""",
    "psi": Q.with_(*_LINES_NUM[:-2]) + "SELECT batch_id, feature, round(psi, 6) AS psi FROM div",
    "jsd": Q.with_(*_EVENTS_CAT) + "SELECT batch_id, feature, round(psi, 6) AS psi, round(jsd, 6) AS jsd FROM cdiv",
    "ks_statistic": Q.with_(*_LINES_NUM) + """SELECT batch_id, feature, round(d, 6) AS ks, m0 AS n_reference, m1 AS n_current FROM ks""",
    "ks_pvalue": Q.with_(*_EVENTS_NUM) + "SELECT batch_id, feature, round(d, 6) AS ks, round(p, 6) AS p_value FROM ks",
    "chi_square": Q.with_(*_EVENTS_CAT) + "SELECT batch_id, feature, round(chi2, 6) AS chi2, round(p, 6) AS p_value FROM chi",
    "sparse_merge": Q.with_(*_EVENTS_CAT) + """SELECT batch_id, feature, k AS columns, n1 AS n_current FROM chi JOIN cs USING (batch_id, feature)""",
    "unseen_categories": Q.with_(*_EVENTS_CAT) + """SELECT batch_id, feature, cell AS category, n FROM c0 ANTI JOIN b0 USING (feature, cell)""",
    "category_alignment": Q.with_(*_ALIGNED) + "SELECT * FROM al",
    "profile_join": Q.with_(B.EVENTS_SQL, *Q.drift(_NUM, ["event_type"])) + """
SELECT batch_id, feature, feature_type, test_name, round(psi, 6) AS psi, status FROM dr
UNION ALL SELECT DISTINCT batch_id, 'props', 'CATEGORICAL', 'CHI2', NULL, 'INSUFFICIENT_DATA' FROM dr""",
    "drift_numeric_features": Q.with_(*_EVENTS_NUM) + f"SELECT {_DRIFT_COLUMNS} FROM nd",
    "drift_categorical_features": Q.with_(*_EVENTS_CAT) + f"SELECT {_DRIFT_COLUMNS} FROM cd",
    "drift_report": Q.with_(*_EVENTS_ALL) + f"SELECT {_DRIFT_COLUMNS}, {_RANK} AS severity FROM dr",
    "drift_report_lineitem": Q.with_(B.LINES_SQL, *Q.drift(B.LINES_NUMERIC, B.LINES_CATEGORICAL)) + f"SELECT {_DRIFT_COLUMNS} FROM dr",
    "status_counts": Q.with_(*_EVENTS_ALL, Q.ROLLUP) + "SELECT * FROM roll",
    "drift_rollup": Q.with_(*_EVENTS_ALL, Q.ROLLUP) + "SELECT * FROM rolled",
    "worst_first": Q.with_(B.RUNS_SQL, B.FEATURES_SQL) + f"""SELECT run_id, feature, status, round(psi, 6) AS psi, {_RANK} AS severity FROM feature_results""",
    "band": f"""WITH x AS (SELECT l_discount, l_tax, {Q.band('l_discount * 3', 0.10, 0.25)} AS a, {Q.band('l_tax * 3', 0.10, 0.20)} AS b FROM lineitem)
SELECT l_discount, l_tax, ['NONE','MODERATE','HIGH'][a+1] AS psi_band, ['NONE','MODERATE','HIGH'][b+1] AS jsd_band,
  ['NONE','MODERATE','HIGH'][greatest(a,b)+1] AS worst, ['NONE','NONE','MODERATE'][greatest(a,b)+1] AS downgraded, count(*) AS n
FROM x GROUP BY ALL""",
    "classify_feature": f"""SELECT l_linenumber, {Q.status('l_discount * 3', 'l_tax * 3', 'l_tax', 'l_quantity', '(l_quantity + 5)')} AS status,
  count(*) AS n FROM lineitem GROUP BY ALL""",
    "missing_rates": Q.with_(*_EVENTS_QUALITY) + "SELECT batch_id, feature, rows, missing, missing_pct FROM qc",
    "out_of_range": Q.with_(*_EVENTS_QUALITY) + """SELECT batch_id, feature, below_min, above_max, out_of_range, out_of_range_pct
FROM qc WHERE type = 'NUMERIC'""",
    "iqr_outliers": Q.with_(*_EVENTS_QUALITY) + "SELECT batch_id, feature, outliers, outlier_pct FROM qc WHERE type = 'NUMERIC'",
    "duplicate_rows": Q.with_(B.EVENTS_DRIFTED_SQL) + f""", again AS (SELECT batch_id, user_id, event_type, value, props FROM batch
  UNION ALL SELECT batch_id, user_id, event_type, value, props FROM batch WHERE event_type IN ('view', 'refund')),
g AS (SELECT batch_id, user_id, event_type, value, props, count(*) AS c FROM again GROUP BY ALL)
SELECT batch_id, sum(c) AS row_count, sum(c) - count(*) AS duplicate_rows, {Q.pct('(sum(c) - count(*))', 'sum(c)')} AS duplicate_pct
FROM g GROUP BY batch_id""",
    "type_mismatch": Q.with_(B.EVENTS_DRIFTED_SQL) + """SELECT DISTINCT batch_id, 'value' AS feature, 'numeric' AS expected, 'text' AS actual
FROM batch WHERE batch_id >= '2024-01-26' AND event_type = 'view'""",
    "quality_score": Q.with_(*_TEXT_QUALITY) + f"""SELECT batch_id, row_count, columns_checked, missing_total, mp AS missing_pct, duplicate_rows,
  dp AS duplicate_pct, mismatch_columns, unseen_columns, outlier_total, op AS outlier_pct, round_even(w1, 4) AS penalty_missing,
  round_even(w2, 4) AS penalty_duplicates, w3 AS penalty_type_mismatches, round_even(w4, 4) AS penalty_unseen_categories,
  round_even(w5, 4) AS penalty_outliers, CAST(round_even(greatest(0.0, 100.0 - (w1 + w2 + w3 + w4 + w5)), 0) AS BIGINT) AS quality_score
FROM (SELECT *, least(30.0, mp * 1.5) AS w1, least(20.0, dp) AS w2, least(20.0, mismatch_columns * 10.0) AS w3,
  least(15.0, unseen_columns * 3.0) AS w4, least(15.0, op * 0.5) AS w5 FROM (SELECT *, {Q.pct('missing_total', 'cells')} AS mp,
  {Q.pct('duplicate_rows', 'row_count')} AS dp, {Q.pct('outlier_total', 'nums')} AS op FROM tq))""",
    "problem_columns": Q.with_(*_EVENTS_QUALITY) + """SELECT batch_id, feature, type, missing_pct, concat_ws('; ',
  CASE WHEN missing_pct > 0 THEN 'missing values' END,
  CASE WHEN unseen = 1 THEN '1 unseen category' WHEN unseen > 1 THEN concat(unseen, ' unseen categories') END,
  CASE WHEN out_of_range > 0 THEN 'out of range' END) AS issues FROM qc
WHERE missing_pct > 0 OR unseen > 0 OR out_of_range > 0""",
    "quality_checks": Q.with_(*_EVENTS_QUALITY) + """, c AS (
  SELECT batch_id, 0 AS position, 'Missing value rate' AS label, missing_pct AS m, 0.05 AS lim, p1 AS pen FROM qr
  UNION ALL SELECT batch_id, 1, 'Duplicate row rate', duplicate_pct, 0.01, p2 FROM qr
  UNION ALL SELECT batch_id, 2, 'Outlier rate', outlier_pct, 0.05, p5 FROM qr)
SELECT batch_id, position, label, concat(format('{:.2f}', m), '%') AS measured, concat(format('{:.2f}', CAST(lim * 100 AS DOUBLE)), '%') AS threshold,
  round_even(pen, 4) AS penalty, m <= lim * 100 AS passed FROM c""",
    "score_batch": f"SELECT doc_id, {B.PREDICTION_RULE} AS prediction_label FROM documents",
    "prediction_distribution": f"""WITH {B.SCORED_SQL}, t AS (SELECT batch_id, count(*) AS total FROM scored GROUP BY batch_id)
SELECT t.batch_id, label, count(y_pred) AS n, round(count(y_pred) / any_value(total), 6) AS share, any_value(total) AS total
FROM t CROSS JOIN (VALUES ('0'), ('1'), ('2')) l(label) LEFT JOIN scored s ON s.batch_id = t.batch_id AND s.y_pred = label
GROUP BY t.batch_id, label""",
    "confusion_matrix": Q.with_(*_PERF[:4]) + """SELECT g.batch_id, g.label AS y_true, h.label AS y_pred, coalesce(n, 0) AS n
FROM grid g JOIN grid h USING (batch_id) LEFT JOIN lab ON lab.batch_id = g.batch_id AND lab.y_true = g.label AND lab.y_pred = h.label""",
    "confusion_rows": Q.with_(*_PERF[:4]) + """SELECT g.batch_id, g.label, h.label AS y_pred, coalesce(n, 0) AS n,
  CAST(g.label AS BIGINT) AS correct_at, g.label = h.label AS diagonal
FROM grid g JOIN grid h USING (batch_id) LEFT JOIN lab ON lab.batch_id = g.batch_id AND lab.y_true = g.label AND lab.y_pred = h.label""",
    "accuracy_error": Q.with_(*_PERF) + """SELECT batch_id, round(hits / sample_count, 6) AS accuracy, sample_count,
  round(1 - hits / sample_count, 6) AS error_rate FROM acc""",
    "macro_metrics": Q.with_(*_PERF) + """SELECT batch_id, round(pm, 6) AS precision_macro, round(rm, 6) AS recall_macro, round(fm, 6) AS f1_macro FROM mac""",
    "positive_class_metrics": Q.with_(*_PERF) + """SELECT batch_id, round(pp, 6) AS precision_positive, round(rp, 6) AS recall_positive,
  round(fp, 6) AS f1_positive, '1' AS positive_class FROM pos""",
    "performance_block": Q.with_(*_PERF) + """SELECT t.batch_id, t.rows, coalesce(sample_count, rows) AS sample_count, sample_count IS NOT NULL AS labels_available,
  round(hits / sample_count, 6) AS accuracy, round(1 - hits / sample_count, 6) AS error_rate, round(pm, 6) AS precision_macro,
  round(rm, 6) AS recall_macro, round(fm, 6) AS f1_macro, round(pp, 6) AS precision_positive, round(rp, 6) AS recall_positive,
  round(fp, 6) AS f1_positive, CASE WHEN sample_count IS NOT NULL THEN '1' END AS positive_class
FROM (SELECT batch_id, count(*) AS rows FROM scored GROUP BY batch_id) t LEFT JOIN acc USING (batch_id)
LEFT JOIN mac USING (batch_id) LEFT JOIN pos USING (batch_id)""",
    "prediction_gate": f"""SELECT (SELECT count(*) FROM documents) AS rows, count(*) AS predictions,
  count(DISTINCT p) FILTER (p NOT IN (SELECT CAST(quality AS VARCHAR) FROM labels)) AS foreign_classes,
  count(DISTINCT p) FILTER (p NOT IN (SELECT CAST(quality AS VARCHAR) FROM labels)) = 0 AS passed
FROM (SELECT {B.PREDICTION_RULE} AS p FROM documents)""",
    "baseline_prediction_mix": f"""SELECT {B.PREDICTION_RULE} AS y_pred, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1""",
    "holdout_evaluation": f"""WITH {B.SCORED_SQL}, x AS (SELECT count(*) FILTER (y_true = y_pred) / count(*) AS a,
  count(*) FILTER (y_true = '1' AND y_pred = '1') AS tp, count(*) FILTER (y_pred = '1') AS pr, count(*) FILTER (y_true = '1') AS su,
  count(*) AS n FROM scored WHERE y_true IS NOT NULL)
SELECT round(a, 6) AS accuracy, round(tp / pr, 6) AS precision, round(tp / su, 6) AS recall, round(2 * tp / (pr + su), 6) AS f1,
  'positive class' AS averaging, n AS sample_count FROM x""",
    "stability_component": Q.with_(B.SCORED_SQL, """m0 AS (SELECT y_pred, count(*) AS n FROM scored GROUP BY y_pred)""",
        """m1 AS (SELECT batch_id, y_pred, count(*) AS n FROM scored GROUP BY batch_id, y_pred)""",
        """mixcells AS (SELECT g.batch_id, 'mix' AS feature, m0.y_pred AS cell, m0.n AS b, coalesce(m1.n, 0) AS c,
  sum(m0.n) OVER (PARTITION BY g.batch_id) AS n0, sum(coalesce(m1.n, 0)) OVER (PARTITION BY g.batch_id) AS n1
  FROM (SELECT DISTINCT batch_id FROM m1) g CROSS JOIN m0 LEFT JOIN m1 ON m1.batch_id = g.batch_id AND m1.y_pred = m0.y_pred)""",
        Q.divergence("mixcells", "mix")) + """SELECT batch_id, round(jsd, 6) AS mix_jsd,
  round(greatest(0.0, 100 - 200 * jsd), 6) AS stability FROM mix""",
    "health_score": Q.with_(*_HEALTH) + f"""SELECT run_id, round(perf, 6) AS health_performance, round(drift, 6) AS health_drift,
  round(qual, 6) AS health_quality, round(stab, 6) AS health_stability,
  CASE WHEN labelled THEN 'with_labels' ELSE 'without_labels' END AS weighting, raw AS health_raw_score, score AS health_score,
  raw <> score AS health_capped, {_BANDS} AS health_band FROM hs""",
    "health_breakdown": Q.with_(*_HEALTH) + """SELECT run_id, 0 AS position, 'Performance' AS component, round_even(perf, 2) AS score,
  CASE WHEN labelled THEN 40.0 ELSE 0.0 END AS weight FROM hs
UNION ALL SELECT run_id, 1, 'Drift', round_even(drift, 2), CASE WHEN labelled THEN 30.0 ELSE 50.0 END FROM hs
UNION ALL SELECT run_id, 2, 'Quality', round_even(qual, 2), CASE WHEN labelled THEN 20.0 ELSE 35.0 END FROM hs
UNION ALL SELECT run_id, 3, 'Stability', round_even(stab, 2), CASE WHEN labelled THEN 10.0 ELSE 15.0 END FROM hs""",
    "explain_numeric": Q.with_(*_EXPLAIN_NUM) + "SELECT * FROM ent",
    "explain_categorical": Q.with_(*_EXPLAIN_CAT) + "SELECT * FROM ect",
    "explain": Q.with_(*_EXPLAIN_NUM, *_EXPLAIN_CAT[1:]) + """SELECT * FROM ent UNION ALL SELECT * FROM ect
UNION ALL SELECT DISTINCT batch_id, 'gone', 'INSUFFICIENT_DATA', '`gone` was not present in this batch, so it could not be assessed.' FROM ect""",
    "driving_measure": Q.with_(B.RUNS_SQL, B.FEATURES_SQL) + f"""SELECT * FROM (SELECT run_id, feature, line_key, {_driver('psi', 'jsd')} AS driver
FROM feature_results) WHERE driver IS NOT NULL""",
    "significance_clause": f"""WITH x AS (SELECT CASE WHEN l_linenumber < 7 THEN l_tax END AS p, l_returnflag = 'R' AS k FROM lineitem)
SELECT {_clause('p', 'k')} AS clause, count(*) AS n FROM x GROUP BY 1""",
    "top_movers": Q.with_(*_EVENTS_CAT, *_MOVERS) + """SELECT batch_id, feature, category, direction, place, round(before, 6) AS before,
  round(after, 6) AS after, round(delta, 6) AS delta FROM mt""",
    "first_k_values": Q.with_(*_EVENTS_CAT, """u AS (SELECT batch_id, feature, list(cell ORDER BY cell) AS l FROM (
  SELECT batch_id, feature, cell FROM c0 ANTI JOIN b0 USING (feature, cell))
  GROUP BY batch_id, feature)""") + """SELECT batch_id, feature, array_to_string(l[1:3], ',') AS first_values, len(l) AS n_unseen,
  greatest(len(l) - 3, 0) AS more FROM u""",
    "format_number_pct_p": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_n('l_extendedprice')} AS price,
  concat(format('{{:.1f}}', l_quantity), '%') AS share, {_p_text('(l_discount / 70)')} AS p FROM lineitem""",
    "display_filters": Q.with_(B.RUNS_SQL, B.FEATURES_SQL) + """SELECT run_id, feature, line_key,
  CASE WHEN p_value < 0.001 THEN '< 0.001' ELSE format('{:.3f}', p_value) END AS p,
  CASE feature_type WHEN 'R' THEN 'K-S' WHEN 'A' THEN 'Chi²' ELSE '—' END AS test,
  concat(format('{:.1f}', psi * 100), '%') AS ratio, concat(format('{:.1f}', test_statistic), '%') AS pct, 'With labels' AS words,
  CASE status WHEN 'HIGH' THEN 'critical' WHEN 'MODERATE' THEN 'warning' WHEN 'NONE' THEN 'good' ELSE 'muted' END AS tone,
  CASE status WHEN 'HIGH' THEN '✕' WHEN 'MODERATE' THEN '▲' WHEN 'NONE' THEN '✓' ELSE '–' END AS icon,
  CASE status WHEN 'HIGH' THEN 'High' WHEN 'MODERATE' THEN 'Moderate' WHEN 'NONE' THEN 'No drift' ELSE 'Not enough data' END AS label
FROM feature_results""",
    "bin_labels": Q.with_(*_LINES_NUM[:5]) + """SELECT feature, i - 1 AS bin, concat(format('{:,.1f}', eds[i]), '–', format('{:,.1f}', eds[i + 1])) AS label
FROM (SELECT feature, eds, unnest(range(1, len(eds))) AS i FROM prof)""",
    "summary_rows": Q.with_(*_LINES_NUM[:3]) + "".join([
        ", s AS (SELECT feature, avg(v) AS a, stddev_pop(v) AS b, min(v) AS c, quantile_cont(v, 0.25) AS d, quantile_cont(v, 0.5) AS e,"
        " quantile_cont(v, 0.75) AS f, max(v) AS g, 0.0 AS h FROM bl GROUP BY feature),"
        " t AS (SELECT batch_id, feature, avg(v) AS a, stddev_pop(v) AS b, min(v) AS c, quantile_cont(v, 0.25) AS d, quantile_cont(v, 0.5) AS e,"
        " quantile_cont(v, 0.75) AS f, max(v) AS g, 0.0 AS h FROM cl GROUP BY batch_id, feature) ",
        " UNION ALL ".join(
            f"SELECT t.batch_id, t.feature, {i} AS position, '{label}' AS label, round(s.{c}, 6) AS baseline, round(t.{c}, 6) AS current"
            " FROM t JOIN s USING (feature)"
            for i, (c, label) in enumerate(zip("abcdefgh", (
                "Mean", "Std deviation", "Minimum", "25th percentile", "Median", "75th percentile", "Maximum", "Missing %"))))]),
    "distribution_compare": Q.with_(*_ALIGNED) + """SELECT batch_id, feature, category, round_even(100.0 * n_baseline / sum(n_baseline) OVER w, 2) AS baseline_pct,
  round_even(100.0 * n_current / sum(n_current) OVER w, 2) AS current_pct FROM al WINDOW w AS (PARTITION BY batch_id, feature)""",
    "distribution_compare_bins": Q.with_(*_LINES_NUM[:8]) + """SELECT batch_id, feature, CAST(cell AS BIGINT) AS bin,
  concat(format('{:,.1f}', eds[CAST(cell AS BIGINT) + 1]), '–', format('{:,.1f}', eds[CAST(cell AS BIGINT) + 2])) AS label,
  b AS baseline, c AS current FROM cells JOIN prof USING (feature)""",
    "run_monitoring": Q.with_(*_RUN_SQL) + _RUN_SELECT + " FROM h3",
    "persist_run": Q.with_(*_RUN_SQL) + _RUN_SELECT + ", features_total AS stored_features FROM h3",
}
ORACLES |= {"stored_summary_rows": ORACLES["summary_rows"], "stored_bins": ORACLES["distribution_compare_bins"]}
