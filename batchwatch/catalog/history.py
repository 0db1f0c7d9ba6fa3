"""Run history, alerts, retraining advice and version comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import status as St
from ..functions import text as X
from ..operators import alerts as A
from ..operators import drift as D
from ..operators import history as H
from ..operators import retrain as R
from ..storage import materialise
from . import bindings as B
from . import sql as Q
from .bindings import rounded

_NOW = "TIMESTAMP '2001-07-15 00:00:00'"
_ALERT_NOW = "TIMESTAMP '2001-10-01 00:00:00'"
_EVENT_NOW = "TIMESTAMP '2024-01-29 12:00:00'"
_THRESHOLD_ROWS = """SELECT CASE WHEN c_nationkey = 0 THEN NULL ELSE c_custkey END AS model_id, {columns}
FROM {customer} WHERE c_nationkey BETWEEN 1 AND 12 OR c_custkey = (SELECT min(c_custkey) FROM {customer} WHERE c_nationkey = 0)"""
_T_COLUMNS = {k: f"CAST({v} AS DOUBLE)" for k, v in S.THRESHOLDS.items()}
_T_COLUMNS |= {"psi_high": "CAST(0.05 + c_nationkey * 0.02 AS DOUBLE)",
               "jsd_high": "CAST(0.08 + c_nationkey * 0.01 AS DOUBLE)",
               "health_critical_threshold": "CAST(74 + c_nationkey AS DOUBLE)"}
_T_LIST = ", ".join(f"{e} AS {c}" for c, e in _T_COLUMNS.items())


def _threshold_rows(spark, sf):
    return spark.sql(_THRESHOLD_ROWS.format(columns=_T_LIST, customer="{customer}"),
                     customer=B.table(spark, sf, "customer"))


_THRESHOLDS_SQL = f"thresholds AS ({_THRESHOLD_ROWS.format(columns=_T_LIST, customer='customer')})"


def _done(spark, sf):
    return B.runs(spark, sf).filter("status = 'COMPLETED'")


# ── access, filters, selection ─────────────────────────────────────────────────────────────────
def preflight(spark, sf):
    return H.preflight(B.models(spark, sf), B.versions(spark, sf), B.baselines(spark, sf))


def visible_models(spark, sf):
    return H.visible_models(B.models(spark, sf), B.grants(spark, sf), F.lit(3)).select("model_id", "name")


def range_filter(spark, sf):
    runs = B.runs(spark, sf)
    parts = [H.in_range(runs, name, F.expr(_NOW)).select(F.lit(name).alias("range_name"), "run_id", "created_at")
             for name in ("24h", "7d", "30d", "nonsense", "all")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def range_filter_all(spark, sf):
    """The runs of the range ``all``."""
    return H.in_range(B.runs(spark, sf), "all", F.expr(_NOW)).select(F.lit("all").alias("range_name"), "run_id", "created_at")


def history_filter(spark, sf):
    return H.filter_history(B.runs(spark, sf), "COMPLETED", "MODERATE", "API").select("run_id", "created_at")


def alert_filter(spark, sf):
    visible = H.visible_models(B.models(spark, sf), B.grants(spark, sf), F.lit(3))
    return H.filter_alerts(B.alerts(spark, sf), visible, "NEW", "CRITICAL").select(
        "model_id", "run_id", "alert_key", "line", "category")


def threshold_validity(spark, sf):
    return H.invalid_thresholds(_threshold_rows(spark, sf)).select("model_id", "problems")


def resolve_thresholds(spark, sf):
    return rounded(H.resolve_thresholds(B.models(spark, sf), _threshold_rows(spark, sf)).select(
        "model_id", "source", "psi_high", "jsd_high", "health_critical_threshold", "alpha"), "psi_high", "jsd_high")


def active_baseline(spark, sf):
    return H.active_baseline(B.models(spark, sf), B.versions(spark, sf), B.baselines(spark, sf))


def reference_accuracy(spark, sf):
    return rounded(H.reference_accuracy(B.versions(spark, sf), B.runs(spark, sf)), "reference_accuracy")


def runs_wide(spark, sf):
    runs = B.runs(spark, sf)
    performance = runs.filter("labels_available").select("run_id", "accuracy", "f1_macro")
    quality = runs.filter("quality_score IS NOT NULL").select("run_id", "quality_score")
    return H.runs_wide(runs.select("run_id", "version_id", "health_score"), performance, quality,
                       B.versions(spark, sf))


def alerts_by_version(spark, sf):
    return H.alerts_of_versions(B.alerts(spark, sf), B.runs(spark, sf)).groupBy(
        "version_id", "severity").agg(F.count("*").alias("alerts"))


def grants_report(spark, sf):
    users = B.table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS user_id", "n_name AS user_name")
    return H.grants_report(B.grants(spark, sf), users, B.models(spark, sf))


# ── aggregates ─────────────────────────────────────────────────────────────────────────────────
def max_psi_per_run(spark, sf):
    return H.max_psi(B.runs(spark, sf), B.feature_results(spark, sf))


def alerts_per_day(spark, sf):
    return A.alerts_per_day(B.alerts(spark, sf), F.expr(f"{_ALERT_NOW} - INTERVAL 90 DAYS"))


def dashboard_counts(spark, sf):
    recommended = B.runs(spark, sf).select(F.when(
        F.col("drift_status") == "HIGH", "OPEN").otherwise("DISMISSED").alias("status"))
    return H.dashboard_counts(B.models(spark, sf), B.alerts(spark, sf), recommended)


def active_users(spark, sf):
    logins = B.table(spark, sf, "events").selectExpr(
        "user_id", "CASE WHEN event_type = 'signup' THEN 'LOGIN_SUCCESS' ELSE 'LOGIN_FAILED' END AS event",
        "ts AS occurred_at")
    return H.active_users(logins, F.expr(_EVENT_NOW))


def version_stats(spark, sf):
    out = H.version_stats(B.versions(spark, sf), B.runs(spark, sf), B.alerts(spark, sf))
    return rounded(out, "training_accuracy", "latest_accuracy", "mean_accuracy", "mean_f1", "mean_recall",
                   "mean_health", "mean_high_drift")


def minority_share(spark, sf):
    return rounded(H.minority_share(B.table(spark, sf, "labels"), "toxic"), "minority_share")


# ── windows ────────────────────────────────────────────────────────────────────────────────────
def latest_run_per_model(spark, sf):
    return H.latest_run(B.runs(spark, sf)).select("model_id", "run_id", "created_at", "health_score")


def consecutive_critical_health(spark, sf):
    out = R.consecutive_below(B.runs(spark, sf), "health_score", F.col("health_critical_threshold"), "critical_twice")
    return out.select("model_id", "run_id", "health_score", "critical_twice")


def consecutive_poor_quality(spark, sf):
    out = R.consecutive_below(B.runs(spark, sf), "quality_score", F.lit(S.POOR_QUALITY), "poor_twice")
    return out.select("model_id", "run_id", "quality_score", "poor_twice")


def auto_resolve(spark, sf):
    return A.auto_resolve(B.runs(spark, sf), B.alerts(spark, sf), F.lit(40)).select(
        "model_id", "run_id", "alert_key", "line", "status", "message")


def feature_history(spark, sf):
    results = B.feature_results(spark, sf).select("model_id", "feature", "run_id", "created_at", "status")
    one = results.groupBy("model_id", "feature", "run_id", "created_at").agg(F.max("status").alias("status"))
    return H.feature_history(one, 5)


def alert_dedup(spark, sf):
    return A.dedup_alerts(B.occurrences(spark, sf), ["model_id"], "ts", "event_id", 24 * 60.0).drop("island")


def alert_dedup_resolved(spark, sf):
    resolved = B.table(spark, sf, "events").filter("event_type = 'purchase'").selectExpr(
        "user_id AS model_id", "ts")
    return A.dedup_alerts(B.occurrences(spark, sf), ["model_id"], "ts", "event_id", 24 * 60.0, resolved).drop("island")


def _triggered(spark, sf):
    runs = B.runs(spark, sf).filter("status = 'COMPLETED'").join(
        H.reference_accuracy(B.versions(spark, sf), B.runs(spark, sf)), "version_id")
    runs = materialise(runs, "scored-runs")
    flagged = materialise(R.consecutive_below(
        runs, "health_score", F.lit(60), "health_critical_twice"), "flagged-runs")
    flagged = R.consecutive_below(flagged, "quality_score", F.lit(50), "quality_poor_twice")
    return R.retrain_triggers(flagged, St.literal_thresholds())


def _recommended(spark, sf):
    return R.retrain_recommendations(_triggered(spark, sf), F.concat(F.lit("model "), F.col("model_id").cast("string")))


def _closings(spark, sf):
    return B.runs(spark, sf).filter("status = 'FAILED'").selectExpr(
        "model_id", "created_at", "CASE WHEN trigger_source = 'MANUAL' THEN 'DISMISSED' ELSE 'ACKNOWLEDGED' END AS action")


def retrain_triggers(spark, sf):
    return _triggered(spark, sf).select("run_id", F.explode("triggers").alias("t")).select(
        "run_id", "t.trigger", "t.measured", "t.threshold", "t.critical")


def retrain_recommendation(spark, sf):
    return _recommended(spark, sf).select("run_id", "severity", "message")


def _opened(spark, sf):
    columns = ["model_id", "run_id", "version_id", "created_at", "severity", "message"]
    recommended = materialise(_recommended(spark, sf).select(*columns), "recommended")
    return R.open_recommendations(recommended, _closings(spark, sf)), recommended


def open_recommendation(spark, sf):
    return _opened(spark, sf)[0].select("model_id", "updates", "opened_at", "updated_at", "run_id", "severity", "status")


def recommendation_alert(spark, sf):
    out = R.recommendation_alerts(
        *_opened(spark, sf), F.concat(F.lit("model "), F.col("model_id").cast("string")))
    return out.select("model_id", "category", "severity", "rule_code", "headline", "run_id", "seen_at")


def version_numbering(spark, sf):
    return H.version_numbers(B.versions(spark, sf).drop("label")).select("version_id", "version_number", "label")


def single_active_version(spark, sf):
    events = B.runs(spark, sf).select(
        "model_id", "version_id", F.col("created_at").alias("activated_at"))
    checks = B.versions(spark, sf).select("version_id", "validation_status")
    return H.single_active_version(events.join(checks, "version_id"))


def downsample_series(spark, sf):
    done = B.runs(spark, sf).select("model_id", "run_id", "created_at", "health_score")
    return H.downsample(done, ["model_id"], ["created_at", "run_id"], F.date_trunc("year", "created_at"), 7).select(
        "model_id", "run_id", "position")


# ── sorts and limits ───────────────────────────────────────────────────────────────────────────
def sortable_results(spark, sf):
    results = B.feature_results(spark, sf).withColumn("p_value", F.when(F.col("p_value") > 0, F.col("p_value")))
    return D.sorted_results(results, "pvalue").select(
        "run_id", "feature", "line_key", F.coalesce("p_value", F.lit(1.0)).alias("sort_key"))


def worst_health_first(spark, sf):
    overview = H.model_overview(B.models(spark, sf), B.runs(spark, sf), B.versions(spark, sf))
    return overview.orderBy("rank_score", "model_id").select("model_id", "rank_score")


def recent_k(spark, sf):
    return H.recent(B.runs(spark, sf), 8, [F.desc("created_at"), F.desc("run_id")]).select("run_id", "created_at")


def page(spark, sf):
    return H.page(B.runs(spark, sf), 3, [F.desc("created_at"), F.desc("run_id")]).select("run_id", "created_at")


def schema_compatible(spark, sf):
    """Every version and its predecessor: are their features the same?"""
    return _with_compatible(spark, sf, _steps(spark, sf))


def _with_compatible(spark, sf, pairs):
    features = B.feature_results(spark, sf).join(
        B.runs(spark, sf).select("run_id", "version_id"), "run_id").groupBy("model_id", "version_id").agg(
        F.collect_set("feature").alias("names"))  # at most one entry per feature column
    a = features.select("model_id", F.col("version_id").alias("a_id"), F.col("names").alias("a_names"))
    b = features.select("model_id", F.col("version_id").alias("b_id"), F.col("names").alias("b_names"))
    return pairs.join(a, ["model_id", "a_id"], "left").join(b, ["model_id", "b_id"], "left").select(
        "model_id", "a_id", "b_id", H.schema_compatible(F.col("a_names"), F.col("b_names")).alias("compatible"))


def _steps(spark, sf):
    """Every version with its predecessor in the model."""
    before = F.lag("version_id").over(Window.partitionBy("model_id").orderBy("version_id"))
    return B.versions(spark, sf).select("model_id", F.col("version_id").alias("a_id"), before.alias("b_id")).filter(
        "b_id IS NOT NULL")


# ── alert rules ────────────────────────────────────────────────────────────────────────────────
def alert_rules(spark, sf):
    runs = B.runs(spark, sf).filter("status = 'COMPLETED'").join(
        H.reference_accuracy(B.versions(spark, sf), B.runs(spark, sf)), "version_id")
    out = A.run_alerts(runs, ["run_id"], St.literal_thresholds())
    drift = A.feature_alerts(B.feature_results(spark, sf), ["run_id"])
    return out.unionByName(drift)


def system_alerts(spark, sf):
    runs = B.runs(spark, sf)
    batches = runs.withColumn("status", F.when(F.col("drift_status") == "NONE", "REJECTED").otherwise("COMPLETED"))
    return A.system_alerts(batches, runs, ["run_id"])


def lifecycle_state(spark, sf):
    actions = B.table(spark, sf, "events").selectExpr(
        "user_id AS alert_id", "ts", "CASE WHEN event_type = 'click' THEN 'ACKNOWLEDGED' "
        "WHEN event_type = 'purchase' THEN 'RESOLVED' END AS action")
    return A.lifecycle_state(actions, "alert_id", "ts", "action", "NEW")


# ── series and comparison ──────────────────────────────────────────────────────────────────────
def performance_series(spark, sf):
    return rounded(H.performance_series(_done(spark, sf)), "accuracy", "precision", "recall", "f1")


def labelled_runs(spark, sf):
    return H.labelled_counts(H.performance_series(_done(spark, sf)))


def drift_series(spark, sf):
    return H.drift_series(_done(spark, sf), B.feature_results(spark, sf))


def health_series(spark, sf):
    return H.health_series(_done(spark, sf))


def prediction_mix_series(spark, sf):
    mix = B.table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))
    return H.prediction_mix_series(_done(spark, sf), mix)


def model_overview(spark, sf):
    return H.model_overview(B.models(spark, sf), B.runs(spark, sf), B.versions(spark, sf)).drop("name")


def _step_comparison(spark, sf):
    stats = materialise(H.version_stats(
        B.versions(spark, sf), B.runs(spark, sf), B.alerts(spark, sf)), "version-stats")
    pairs = materialise(_with_compatible(spark, sf, _steps(spark, sf)), "version-pairs")
    return H.version_comparison(pairs, stats)


def version_comparison(spark, sf):
    """Every version beside its predecessor; drift is compared if their features are the same."""
    return rounded(_step_comparison(spark, sf), "a_value", "b_value", "delta")


def comparison_verdict(spark, sf):
    return H.comparison_verdict(_step_comparison(spark, sf))


# the same under the names they first had
def version_steps(spark, sf):
    return version_comparison(spark, sf)


def version_steps_verdict(spark, sf):
    return comparison_verdict(spark, sf)


def time_labels(spark, sf):
    return B.table(spark, sf, "events").select(
        "event_id", X.time_label(F.col("ts")).alias("label"), F.to_date("ts").cast("string").alias("day"))


def accuracy_drop(spark, sf):
    runs = B.runs(spark, sf).filter("labels_available").join(
        H.reference_accuracy(B.versions(spark, sf), B.runs(spark, sf)), "version_id")
    return rounded(runs.select("run_id", (St.accuracy_drop(F.col("accuracy"), F.col("reference_accuracy")) * 100
                                          ).alias("points")), "points")


QUERIES = {f.__name__: f for f in (
    preflight, visible_models, range_filter, range_filter_all, history_filter, alert_filter, threshold_validity,
    resolve_thresholds, active_baseline, reference_accuracy, runs_wide, alerts_by_version, grants_report,
    max_psi_per_run, alerts_per_day, dashboard_counts, active_users, version_stats, minority_share,
    latest_run_per_model, consecutive_critical_health, consecutive_poor_quality, auto_resolve,
    feature_history, alert_dedup, alert_dedup_resolved, retrain_triggers, retrain_recommendation,
    open_recommendation, recommendation_alert, version_numbering, single_active_version,
    downsample_series, sortable_results, worst_health_first, recent_k, page, schema_compatible,
    alert_rules, system_alerts, lifecycle_state, performance_series, labelled_runs, drift_series,
    health_series, prediction_mix_series, model_overview, version_comparison, comparison_verdict,
    version_steps, version_steps_verdict,
    time_labels, accuracy_drop)}

# ── the same in SQL ────────────────────────────────────────────────────────────────────────────
_RV = Q.with_(B.RUNS_SQL, B.VERSIONS_SQL)
_REF = """refacc AS (SELECT v.version_id, coalesce(v.training_accuracy, f.accuracy) AS reference_accuracy
  FROM versions v LEFT JOIN (SELECT version_id, min_by(accuracy, (created_at, run_id)) AS accuracy
    FROM runs WHERE labels_available GROUP BY version_id) f USING (version_id))"""
_RVR = Q.with_(B.RUNS_SQL, B.VERSIONS_SQL, _REF)
_LATEST = """latest AS (SELECT * FROM runs WHERE status = 'COMPLETED'
  QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, run_id DESC) = 1)"""


def _range_sql(name: str, days: int) -> str:
    return (f"SELECT '{name}' AS range_name, run_id, created_at FROM runs WHERE status = 'COMPLETED' "
            f"AND created_at >= {_NOW} - INTERVAL {days} DAYS")


def _twice(score: str, limit: str, out: str) -> str:
    return f"""SELECT model_id, run_id, {score}, coalesce({score} < {limit} AND lag({score} < {limit}) OVER w, false) AS {out}
FROM runs WHERE {score} IS NOT NULL WINDOW w AS (PARTITION BY model_id ORDER BY created_at, run_id)"""


_TRIGGERS = [B.RUNS_SQL, B.VERSIONS_SQL, _REF, """flagged AS (SELECT r.*, reference_accuracy, reference_accuracy - accuracy AS drop_,
  features_high + features_moderate AS drifted,
  coalesce(health_score < 60 AND lag(health_score < 60) OVER w, false) AS hc, coalesce(quality_score < 50 AND lag(quality_score < 50) OVER w, false) AS qp
  FROM runs r JOIN refacc USING (version_id) WHERE status = 'COMPLETED'
  WINDOW w AS (PARTITION BY model_id ORDER BY created_at, run_id))""",
    """trig AS (SELECT run_id, 1 AS i, 'Overall drift status is HIGH' AS trigger, concat(features_high, ' feature(s) at high drift') AS measured,
  'any feature at high drift' AS threshold, true AS critical FROM flagged WHERE drift_status = 'HIGH'
  UNION ALL SELECT run_id, 2, 'Several features have drifted', concat(drifted, ' features at moderate drift or worse'), '3 or more', false FROM flagged WHERE drifted >= 3
  UNION ALL SELECT run_id, 3, 'Accuracy has fallen below its reference', concat(format('{:.4f}', accuracy), ' (', format('{:.1f}', drop_ * 100),
    ' points below ', format('{:.4f}', reference_accuracy), ')'), '5 point drop', true FROM flagged WHERE drop_ >= 0.05
  UNION ALL SELECT run_id, 4, 'Health score has stayed critical', concat('2 consecutive runs below 60 (latest ', health_score, ')'), 'below 60 for 2 runs', true FROM flagged WHERE hc
  UNION ALL SELECT run_id, 5, 'Incoming data quality has stayed poor', concat('2 consecutive runs below 50 (latest ', quality_score, ')'), 'below 50 for 2 runs', false FROM flagged WHERE qp)""",
    """rec AS (SELECT run_id, model_id, version_id, created_at, CASE WHEN bool_or(critical) OR count(*) >= 2 THEN 'URGENT' ELSE 'ADVISED' END AS severity,
  concat('Retraining is recommended for model ', model_id, '.', chr(10),
    string_agg(concat('  · ', trigger, ': ', measured, ' (threshold: ', threshold, ')'), chr(10) ORDER BY i), chr(10),
    'This is advisory only — the platform does not retrain models.') AS message
  FROM trig JOIN runs USING (run_id) GROUP BY run_id, model_id, version_id, created_at)"""]
_OPENED = [*_TRIGGERS, """closing AS (SELECT model_id, created_at, CASE WHEN trigger_source = 'MANUAL' THEN 'DISMISSED' ELSE 'ACKNOWLEDGED' END AS action
  FROM runs WHERE status = 'FAILED')""",
    """numbered AS (SELECT r.*, (SELECT count(*) FROM closing c WHERE c.model_id = r.model_id AND c.created_at < r.created_at) AS island FROM rec r)""",
    """isl AS (SELECT model_id, island, count(*) AS updates, min(created_at) AS opened_at, max(created_at) AS updated_at,
  arg_max(run_id, (created_at, run_id)) AS run_id, arg_min(run_id, (created_at, run_id)) AS first_run_id,
  arg_max(severity, (created_at, run_id)) AS severity FROM numbered GROUP BY model_id, island)""",
    """cr AS (SELECT model_id, action, row_number() OVER (PARTITION BY model_id ORDER BY created_at) - 1 AS island
  FROM (SELECT DISTINCT model_id, created_at, action FROM closing))"""]
_COMPARE_STATS = """done AS (SELECT * FROM runs WHERE status = 'COMPLETED'),
st AS (SELECT v.version_id, v.model_id, v.label, v.training_accuracy,
  (SELECT arg_max(CASE WHEN accuracy IS NULL THEN -1 ELSE accuracy END, (created_at, run_id)) FROM done d WHERE d.version_id = v.version_id) AS la,
  p.* EXCLUDE (version_id), coalesce(run_count, 0) AS runs_, coalesce(alert_count, 0) AS alerts_ FROM versions v
  LEFT JOIN (SELECT version_id, avg(accuracy) FILTER (labels_available) AS mean_accuracy, avg(f1_positive) FILTER (labels_available) AS mean_f1,
    avg(recall_positive) FILTER (labels_available) AS mean_recall, avg(health_score) AS mean_health, avg(features_high) AS mean_high_drift,
    count(*) AS run_count FROM done GROUP BY version_id) p USING (version_id)
  LEFT JOIN (SELECT version_id, count(*) AS alert_count FROM alerts GROUP BY version_id) a USING (version_id)),
stats AS (SELECT version_id, model_id, label, training_accuracy, CASE WHEN la >= 0 THEN la END AS latest_accuracy, mean_accuracy, mean_f1,
  mean_recall, mean_health, mean_high_drift, runs_ AS run_count, alerts_ AS alert_count FROM st)"""


def _compare_row(i: int, name: str, label: str, more: bool | None, compatible: str = "p.model_id % 2 = 0") -> str:
    if more is None:
        winner, delta = "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"
    else:
        winner = f"CASE WHEN a.{name} <> b.{name} THEN CASE WHEN a.{name} {'>' if more else '<'} b.{name} THEN 'a' ELSE 'b' END END"
        delta = f"CASE WHEN a.{name} <> b.{name} THEN CAST(abs(a.{name} - b.{name}) AS DOUBLE) END"
    where = f" WHERE {compatible}" if name == "mean_high_drift" else ""
    return (f"SELECT p.model_id, a_id, b_id, a.label AS a_label, b.label AS b_label, {i} AS position, '{label}' AS measure, "
            f"CAST(a.{name} AS DOUBLE) AS a_value, CAST(b.{name} AS DOUBLE) AS b_value, {winner} AS winner, {delta} AS delta "
            f"FROM pairs p JOIN stats a ON a.version_id = a_id JOIN stats b ON b.version_id = b_id{where}")


_STEPS = """fs AS (SELECT version_id, list_sort(list(DISTINCT feature)) AS l
  FROM feature_results f JOIN runs r ON r.run_id = f.run_id GROUP BY version_id),
steps AS (SELECT model_id, version_id AS a_id, lag(version_id) OVER (PARTITION BY model_id ORDER BY version_id) AS b_id FROM versions),
pairs AS (SELECT s.model_id, a_id, b_id, a.l IS NULL OR b.l IS NULL OR a.l = b.l AS compatible FROM steps s
  LEFT JOIN fs a ON a.version_id = a_id LEFT JOIN fs b ON b.version_id = b_id WHERE b_id IS NOT NULL)"""
_COMPARE_STEPS = [B.RUNS_SQL, B.VERSIONS_SQL, B.ALERTS_SQL, B.FEATURES_SQL, _COMPARE_STATS, _STEPS,
                  "cmp AS (" + " UNION ALL ".join(_compare_row(i, *c, "p.compatible") for i, c in enumerate(H.COMPARED)) + ")"]
_SIDE_BY_SIDE = """SELECT model_id, a_id, b_id, a_label, b_label, position, measure, round(a_value, 6) AS a_value,
  round(b_value, 6) AS b_value, winner, round(delta, 6) AS delta FROM cmp"""
_VERDICT = """, v AS (SELECT model_id, a_id, b_id, a_label, b_label, count(*) FILTER (winner = 'a') AS wa,
  count(*) FILTER (winner = 'b') AS wb, count(*) AS n, CAST(sum(a_value + b_value) FILTER (measure = 'Monitoring runs') AS BIGINT) AS runs,
  max(winner) FILTER (measure = 'Mean accuracy') AS aw, max(delta) FILTER (measure = 'Mean accuracy') AS ad FROM cmp GROUP BY ALL)
SELECT model_id, a_id, b_id, CASE WHEN wa = wb THEN concat(a_label, ' and ', b_label, ' are evenly matched across ', n, ' measures over ', runs, ' runs.')
  ELSE concat(CASE WHEN wa > wb THEN a_label ELSE b_label END, ' outperforms ', CASE WHEN wa > wb THEN b_label ELSE a_label END, ' on ',
    greatest(wa, wb), ' of ', n, ' measures', CASE WHEN ad IS NOT NULL THEN concat(', ',
      CASE WHEN aw = CASE WHEN wa > wb THEN 'a' ELSE 'b' END THEN 'ahead on' ELSE 'behind on' END, ' mean accuracy by ',
      format('{:.1f}', ad * 100), ' points') ELSE '' END, ', across ', runs, ' runs.') END AS verdict FROM v"""


def _dedup_sql(resolutions: bool) -> str:
    marks = ("UNION ALL SELECT user_id, ts, NULL, NULL, NULL, 1 FROM events WHERE event_type = 'purchase'" if resolutions else "")
    return Q.with_(B.OCCURRENCES_SQL, f"allr AS (SELECT model_id, ts, event_id, severity, message, 0 AS res FROM occ {marks})",
                   """f AS (SELECT *, CASE WHEN res = 1 THEN 0 WHEN lag(ts) OVER w IS NULL OR lag(res) OVER w = 1
    OR ts - lag(ts) OVER w > INTERVAL 24 HOURS THEN 1 ELSE 0 END AS s FROM allr WINDOW w AS (PARTITION BY model_id ORDER BY ts, res, event_id))""",
                   "i AS (SELECT *, sum(s) OVER (PARTITION BY model_id ORDER BY ts, res, event_id) AS island FROM f)") + """
SELECT model_id, count(*) AS occurrence_count, min(ts) AS first_seen_at, max(ts) AS last_seen_at, arg_max(event_id, (ts, event_id)) AS event_id,
  arg_max(severity, (ts, event_id)) AS severity, arg_max(message, (ts, event_id)) AS message
FROM i WHERE res = 0 GROUP BY model_id, island"""


_RUN_ALERTS = """ra AS (SELECT r.*, reference_accuracy, reference_accuracy - accuracy AS dr FROM runs r JOIN refacc USING (version_id) WHERE status = 'COMPLETED')"""

ORACLES = {
    "preflight": Q.with_(B.RUNS_SQL, B.MODELS_SQL, B.VERSIONS_SQL, B.BASELINES_SQL) + """SELECT model_id, CASE
  WHEN NOT is_active THEN concat('''', name, ''' is deactivated and accepts no batches.')
  WHEN model_id NOT IN (SELECT model_id FROM versions WHERE status = 'ACTIVE') THEN concat('''', name, ''' has no active version. Upload and activate one first.')
  WHEN model_id NOT IN (SELECT model_id FROM baselines) THEN concat('''', name, ''' has no baseline dataset.') END AS refusal_reason FROM models""",
    "visible_models": Q.with_(B.MODELS_SQL, B.GRANTS_SQL) + """SELECT model_id, name FROM models
WHERE owner_id = 3 OR model_id IN (SELECT model_id FROM grants WHERE user_id = 3)""",
    "range_filter": Q.with_(B.RUNS_SQL) + " UNION ALL ".join(
        _range_sql(n, d) for n, d in (("24h", 1), ("7d", 7), ("30d", 30), ("nonsense", 30)))
        + " UNION ALL SELECT 'all' AS range_name, run_id, created_at FROM runs WHERE status = 'COMPLETED'",
    "range_filter_all": Q.with_(B.RUNS_SQL) + "SELECT 'all' AS range_name, run_id, created_at FROM runs WHERE status = 'COMPLETED'",
    "history_filter": Q.with_(B.RUNS_SQL) + """SELECT run_id, created_at FROM runs
WHERE status = 'COMPLETED' AND drift_status = 'MODERATE' AND trigger_source = 'API'""",
    "alert_filter": Q.with_(B.RUNS_SQL, B.MODELS_SQL, B.GRANTS_SQL, B.ALERTS_SQL) + """SELECT model_id, run_id, alert_key, line, category FROM alerts
WHERE status = 'NEW' AND severity = 'CRITICAL' AND model_id IN (SELECT model_id FROM models
  WHERE owner_id = 3 OR model_id IN (SELECT model_id FROM grants WHERE user_id = 3))""",
    "threshold_validity": Q.with_(_THRESHOLDS_SQL) + """SELECT * FROM (SELECT model_id, concat_ws(',',
  CASE WHEN psi_moderate >= psi_high THEN 'psi' END, CASE WHEN jsd_moderate >= jsd_high THEN 'jsd' END,
  CASE WHEN health_critical_threshold >= health_warning_threshold THEN 'health' END) AS problems FROM thresholds) WHERE problems <> ''""",
    "resolve_thresholds": Q.with_(_THRESHOLDS_SQL, B.MODELS_SQL) + """SELECT m.model_id, CASE WHEN t.model_id IS NOT NULL THEN 'model' ELSE 'global' END AS source,
  round(CASE WHEN t.model_id IS NOT NULL THEN t.psi_high ELSE g.psi_high END, 6) AS psi_high,
  round(CASE WHEN t.model_id IS NOT NULL THEN t.jsd_high ELSE g.jsd_high END, 6) AS jsd_high,
  CASE WHEN t.model_id IS NOT NULL THEN t.health_critical_threshold ELSE g.health_critical_threshold END AS health_critical_threshold,
  CASE WHEN t.model_id IS NOT NULL THEN t.alpha ELSE g.alpha END AS alpha
FROM models m LEFT JOIN thresholds t ON t.model_id = m.model_id CROSS JOIN (SELECT * FROM thresholds WHERE model_id IS NULL) g""",
    "active_baseline": Q.with_(B.RUNS_SQL, B.MODELS_SQL, B.VERSIONS_SQL, B.BASELINES_SQL) + """, r AS (SELECT b.*, coalesce(v.version_id = b.version_id, false) AS linked
  FROM baselines b LEFT JOIN versions v ON v.model_id = b.model_id AND v.status = 'ACTIVE')
SELECT m.model_id, x.baseline_id, x.linked FROM models m LEFT JOIN (SELECT * FROM r
  QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY linked DESC, created_at DESC, baseline_id DESC) = 1) x USING (model_id)""",
    "reference_accuracy": _RVR + "SELECT version_id, round(reference_accuracy, 6) AS reference_accuracy FROM refacc",
    "runs_wide": _RV + """SELECT r.run_id, r.version_id, r.health_score, CASE WHEN labels_available THEN accuracy END AS accuracy,
  CASE WHEN labels_available THEN f1_macro END AS f1_macro, quality_score, v.label AS version_label FROM runs r LEFT JOIN versions v USING (version_id)""",
    "alerts_by_version": Q.with_(B.RUNS_SQL, B.ALERTS_SQL) + "SELECT version_id, severity, count(*) AS alerts FROM alerts GROUP BY version_id, severity",
    "grants_report": Q.with_(B.MODELS_SQL, B.GRANTS_SQL) + """SELECT u.n_name AS user_name, m.name, permission, g2.n_name AS giver FROM grants g
JOIN nation u ON u.n_nationkey = g.user_id JOIN models m USING (model_id) LEFT JOIN nation g2 ON g2.n_nationkey = g.granted_by""",
    "max_psi_per_run": Q.with_(B.RUNS_SQL, B.FEATURES_SQL) + """SELECT runs.run_id, round_even(max(psi), 4) AS max_psi FROM runs
LEFT JOIN feature_results f ON f.run_id = runs.run_id GROUP BY runs.run_id""",
    "alerts_per_day": Q.with_(B.RUNS_SQL, B.ALERTS_SQL) + f"""SELECT model_id, CAST(first_seen_at AS DATE) AS day, count(*) FILTER (severity = 'INFO') AS info,
  count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'CRITICAL') AS critical
FROM alerts WHERE first_seen_at >= {_ALERT_NOW} - INTERVAL 90 DAYS GROUP BY 1, 2""",
    "dashboard_counts": Q.with_(B.RUNS_SQL, B.ALERTS_SQL) + """SELECT (SELECT count(*) FROM customer) AS total_models,
  (SELECT count(*) FROM alerts WHERE status IN ('NEW', 'ACKNOWLEDGED')) AS unresolved_alerts,
  (SELECT count(*) FROM runs WHERE drift_status = 'HIGH') AS open_recommendations""",
    "active_users": f"""SELECT count(DISTINCT user_id) AS active_users FROM events
WHERE event_type = 'signup' AND ts >= {_EVENT_NOW} - INTERVAL 1 DAYS""",
    "version_stats": Q.with_(B.RUNS_SQL, B.VERSIONS_SQL, B.ALERTS_SQL, _COMPARE_STATS) + """SELECT version_id, model_id, label, round(training_accuracy, 6) AS training_accuracy,
  round(latest_accuracy, 6) AS latest_accuracy, round(mean_accuracy, 6) AS mean_accuracy, round(mean_f1, 6) AS mean_f1, round(mean_recall, 6) AS mean_recall,
  round(mean_health, 6) AS mean_health, round(mean_high_drift, 6) AS mean_high_drift, run_count, alert_count FROM stats""",
    "minority_share": """SELECT round(min(c) / sum(c), 6) AS minority_share FROM (SELECT count(*) AS c FROM labels GROUP BY toxic)""",
    "latest_run_per_model": Q.with_(B.RUNS_SQL, _LATEST) + "SELECT model_id, run_id, created_at, health_score FROM latest",
    "consecutive_critical_health": Q.with_(B.RUNS_SQL) + f"""SELECT model_id, run_id, health_score,
  coalesce(health_score < health_critical_threshold AND lag(health_score) OVER w < health_critical_threshold, false) AS critical_twice
FROM runs WHERE health_score IS NOT NULL WINDOW w AS (PARTITION BY model_id ORDER BY created_at, run_id)""",
    "consecutive_poor_quality": Q.with_(B.RUNS_SQL) + _twice("quality_score", "50", "poor_twice"),
    "auto_resolve": Q.with_(B.RUNS_SQL, B.ALERTS_SQL) + """, last3 AS (SELECT model_id, health_score FROM runs WHERE health_score IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, run_id DESC) <= 3),
clean AS (SELECT model_id FROM last3 GROUP BY model_id HAVING count(*) = 3 AND min(health_score) >= 40)
SELECT model_id, run_id, alert_key, line, 'RESOLVED' AS status, concat(message, ' [Auto-resolved — condition cleared]') AS message FROM alerts
WHERE category = 'HEALTH' AND status IN ('NEW', 'ACKNOWLEDGED') AND model_id IN (SELECT model_id FROM clean)""",
    "feature_history": Q.with_(B.RUNS_SQL, B.FEATURES_SQL) + """, one AS (SELECT model_id, feature, run_id, created_at, max(status) AS status
  FROM feature_results GROUP BY ALL), l AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY model_id, feature ORDER BY created_at DESC, run_id DESC) <= 5)
SELECT *, row_number() OVER (PARTITION BY model_id, feature ORDER BY created_at, run_id) AS place FROM l""",
    "alert_dedup": _dedup_sql(False),
    "alert_dedup_resolved": _dedup_sql(True),
    "retrain_triggers": Q.with_(*_TRIGGERS) + "SELECT run_id, trigger, measured, threshold, critical FROM trig",
    "retrain_recommendation": Q.with_(*_TRIGGERS) + "SELECT run_id, severity, message FROM rec",
    "recommendation_alert": Q.with_(*_OPENED) + """SELECT model_id, 'RETRAIN' AS category, 'CRITICAL' AS severity, 'RETRAIN_RECOMMENDED' AS rule_code,
  concat('Retraining recommended for model ', model_id) AS headline, first_run_id AS run_id, opened_at AS seen_at FROM isl""",
    "version_numbering": _RV + """, n AS (SELECT version_id, row_number() OVER (PARTITION BY model_id ORDER BY uploaded_at, version_id) AS version_number FROM versions)
SELECT *, concat('V', version_number) AS label FROM n""",
    "single_active_version": _RV + """SELECT model_id, arg_max(version_id, (created_at, version_id)) AS version_id, max(created_at) AS activated_at
FROM (SELECT r.* FROM runs r JOIN versions v USING (version_id) WHERE validation_status <> 'FAILED') GROUP BY model_id""",
    "downsample_series": Q.with_(B.RUNS_SQL) + """, p AS (SELECT model_id, run_id, row_number() OVER (PARTITION BY model_id ORDER BY created_at, run_id) AS position,
  count(*) OVER (PARTITION BY model_id) AS n FROM runs)
SELECT model_id, run_id, position FROM p WHERE n <= 7 OR position = n
  OR list_contains(list_transform(range(0, 6), lambda j: CAST(floor(j * (n / 7.0::DOUBLE)) AS BIGINT)), position - 1)""",
    "sortable_results": Q.with_(B.RUNS_SQL, B.FEATURES_SQL) + """SELECT run_id, feature, line_key, CASE WHEN p_value > 0 THEN p_value ELSE 1.0 END AS sort_key FROM feature_results""",
    "worst_health_first": Q.with_(B.RUNS_SQL, B.MODELS_SQL, _LATEST) + """SELECT m.model_id, coalesce(health_score, 101) AS rank_score
FROM models m LEFT JOIN latest USING (model_id) """,
    "recent_k": Q.with_(B.RUNS_SQL) + "SELECT run_id, created_at FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 8",
    "page": Q.with_(B.RUNS_SQL) + "SELECT run_id, created_at FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 25 OFFSET 50",
    "schema_compatible": Q.with_(B.RUNS_SQL, B.VERSIONS_SQL, B.FEATURES_SQL, _STEPS) + "SELECT model_id, a_id, b_id, compatible FROM pairs",
    "alert_rules": Q.with_(B.RUNS_SQL, B.VERSIONS_SQL, _REF, B.FEATURES_SQL, _RUN_ALERTS) + """
SELECT run_id, 'PERFORMANCE' AS category, '' AS feature, CASE WHEN dr >= 0.1 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  CASE WHEN dr >= 0.1 THEN 'PERFORMANCE_DROP_MAJOR' ELSE 'PERFORMANCE_DROP_MINOR' END AS rule_code,
  CASE WHEN dr >= 0.1 THEN 'Accuracy has fallen sharply' ELSE 'Accuracy has fallen' END AS headline,
  concat('Accuracy is ', format('{:.4f}', accuracy), ', ', format('{:.1f}', dr * 100), ' points below the reference of ', format('{:.4f}', reference_accuracy), '.') AS message
FROM ra WHERE dr >= 0.05
UNION ALL SELECT run_id, 'QUALITY', '', CASE WHEN quality_score < 50 THEN 'CRITICAL' ELSE 'WARNING' END,
  CASE WHEN quality_score < 50 THEN 'QUALITY_POOR' ELSE 'QUALITY_DEGRADED' END,
  CASE WHEN quality_score < 50 THEN 'Incoming data quality is poor' ELSE 'Incoming data quality has degraded' END,
  concat('Data quality scored ', quality_score, '/100.') FROM ra WHERE quality_score < 70
UNION ALL SELECT run_id, 'HEALTH', '', CASE WHEN health_score < 60 THEN 'CRITICAL' ELSE 'WARNING' END,
  CASE WHEN health_score < 60 THEN 'HEALTH_CRITICAL' ELSE 'HEALTH_WARNING' END,
  CASE WHEN health_score < 60 THEN 'Model health is critical' ELSE 'Model health has degraded' END,
  concat('Health score ', health_score, CASE WHEN health_score < 60 THEN '/100, below the critical threshold of 60.' ELSE '/100, below the healthy threshold of 80.' END)
FROM ra WHERE health_score < 80
UNION ALL SELECT run_id, 'DRIFT', feature, CASE WHEN status = 'HIGH' THEN 'CRITICAL' ELSE 'WARNING' END, concat('DRIFT_', status),
  concat(CASE WHEN status = 'HIGH' THEN 'High' ELSE 'Moderate' END, ' drift detected — ', feature),
  concat('PSI ', format('{:.3f}', psi), ' exceeds the ', lower(status), ' threshold.') FROM feature_results WHERE status IN ('HIGH', 'MODERATE')""",
    "system_alerts": Q.with_(B.RUNS_SQL) + """SELECT run_id, 'SYSTEM' AS category, '' AS feature, 'WARNING' AS severity, 'BATCH_REJECTED' AS rule_code,
  'Batch rejected' AS headline, message FROM runs WHERE drift_status = 'NONE'
UNION ALL SELECT run_id, 'SYSTEM', '', 'CRITICAL', 'RUN_FAILED', concat('Monitoring run #', run_id, ' failed'), message FROM runs WHERE status = 'FAILED'""",
    "lifecycle_state": """WITH a AS (SELECT user_id AS alert_id, ts, CASE event_type WHEN 'click' THEN 'ACKNOWLEDGED' WHEN 'purchase' THEN 'RESOLVED' END AS action FROM events)
SELECT alert_id, coalesce(arg_max(action, ts) FILTER (action IS NOT NULL), 'NEW') AS state, count(action) AS actions FROM a GROUP BY alert_id""",
    "performance_series": Q.with_(B.RUNS_SQL) + """SELECT model_id, run_id, strftime(created_at, '%d %b %H:%M') AS label, CASE WHEN labels_available THEN round(accuracy, 6) END AS accuracy,
  CASE WHEN labels_available THEN round(coalesce(nullif(precision_positive, 0), precision_macro), 6) END AS precision,
  CASE WHEN labels_available THEN round(coalesce(nullif(recall_positive, 0), recall_macro), 6) END AS recall,
  CASE WHEN labels_available THEN round(coalesce(nullif(f1_positive, 0), f1_macro), 6) END AS f1 FROM runs WHERE status = 'COMPLETED'""",
    "labelled_runs": Q.with_(B.RUNS_SQL) + """SELECT model_id, count(*) FILTER (labels_available) AS labelled_runs, count(*) FILTER (NOT labels_available) AS unlabelled_runs
FROM runs WHERE status = 'COMPLETED' GROUP BY model_id""",
    "drift_series": Q.with_(B.RUNS_SQL, B.FEATURES_SQL) + """SELECT r.model_id, r.run_id, features_high AS high, features_moderate AS moderate,
  features_total - features_high - features_moderate - features_insufficient AS clean, m.max_psi
FROM runs r LEFT JOIN (SELECT run_id, round_even(max(psi), 4) AS max_psi FROM feature_results GROUP BY run_id) m USING (run_id) WHERE r.status = 'COMPLETED'""",
    "health_series": Q.with_(B.RUNS_SQL, _LATEST) + """SELECT r.model_id, r.run_id, r.health_score, r.health_band,
  l.health_warning_threshold AS warning_at, l.health_critical_threshold AS critical_at FROM runs r JOIN latest l USING (model_id) WHERE r.status = 'COMPLETED'""",
    "prediction_mix_series": Q.with_(B.RUNS_SQL) + """, mix AS (SELECT r.model_id, r.run_id, l_returnflag AS label, count(*) AS n
  FROM lineitem JOIN runs r ON r.run_id = l_orderkey WHERE r.status = 'COMPLETED' GROUP BY ALL),
cl AS (SELECT DISTINCT model_id, label FROM mix), tot AS (SELECT run_id, sum(n) AS t FROM mix GROUP BY run_id)
SELECT r.model_id, r.run_id, cl.label, round_even(coalesce(100.0 * mix.n / t, 0.0), 2) AS share FROM runs r JOIN cl USING (model_id)
LEFT JOIN mix ON mix.run_id = r.run_id AND mix.label = cl.label LEFT JOIN tot ON tot.run_id = r.run_id WHERE r.status = 'COMPLETED'""",
    "model_overview": Q.with_(B.RUNS_SQL, B.MODELS_SQL, B.VERSIONS_SQL, _LATEST) + """SELECT m.model_id, l.run_id, l.health_score,
  (SELECT max(version_id) FROM versions v WHERE v.model_id = m.model_id AND v.status = 'ACTIVE') AS active_version_id,
  (SELECT count(*) FROM versions v WHERE v.model_id = m.model_id) AS version_count,
  coalesce(l.health_band IN ('WARNING', 'CRITICAL'), false) AS needs_attention, coalesce(l.health_score, 101) AS rank_score
FROM models m LEFT JOIN latest l USING (model_id)""",
    "version_comparison": Q.with_(*_COMPARE_STEPS) + _SIDE_BY_SIDE,
    "comparison_verdict": Q.with_(*_COMPARE_STEPS) + _VERDICT,
    "version_steps": Q.with_(*_COMPARE_STEPS) + _SIDE_BY_SIDE,
    "version_steps_verdict": Q.with_(*_COMPARE_STEPS) + _VERDICT,
    "time_labels": "SELECT event_id, strftime(ts, '%d %b %H:%M') AS label, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "accuracy_drop": _RVR + """SELECT run_id, round((reference_accuracy - accuracy) * 100, 6) AS points FROM runs JOIN refacc USING (version_id) WHERE labels_available""",
}
ORACLES["open_recommendation"] = Q.with_(*_OPENED[:-1]) + """, closed AS (SELECT i.model_id, i.island, max(c.action) AS action FROM isl i JOIN (
  SELECT model_id, created_at, action, (SELECT count(*) FROM closing d WHERE d.model_id = c0.model_id AND d.created_at < c0.created_at) AS before_
  FROM closing c0) c ON c.model_id = i.model_id AND c.created_at >= i.updated_at AND c.before_ = i.island GROUP BY 1, 2)
SELECT isl.model_id, updates, opened_at, updated_at, run_id, severity, coalesce(action, 'OPEN') AS status FROM isl LEFT JOIN closed USING (model_id, island)"""
