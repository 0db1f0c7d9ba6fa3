"""Run-history, access and version-comparison queries."""

# Fixed texts: the sentences in this module are part of the results and have to stay as they are.
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import text as X
from .ordered import attach_positions, newest, positions

RANGE_DAYS = {"24h": 1, "7d": 7, "30d": 30, "all": None}
DEFAULT_RANGE = "30d"
_RUN_ORDER = ["created_at", "run_id"]


def visible_models(models: DataFrame, grants: DataFrame, user_id: Column, is_admin: bool = False) -> DataFrame:
    """Everything for an admin; else models the user owns or was granted, each once."""
    if is_admin:
        return models
    granted = grants.filter(F.col("user_id") == user_id).select("model_id").distinct()
    joined = models.join(granted.withColumn("_granted", F.lit(True)), "model_id", "left")
    return joined.filter((F.col("owner_id") == user_id) | F.col("_granted")).drop("_granted")


def in_range(runs: DataFrame, name: str, now: Column) -> DataFrame:
    """COMPLETED runs of the last 24h / 7d / 30d / all; unknown names mean 30 days."""
    days = RANGE_DAYS.get(name, RANGE_DAYS[DEFAULT_RANGE])
    done = runs.filter(F.col("status") == S.COMPLETED)
    if days is None:
        return done
    return done.filter(F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def filter_history(runs: DataFrame, status: str = "", drift: str = "", trigger: str = "") -> DataFrame:
    for column, wanted in (("status", status), ("drift_status", drift), ("trigger_source", trigger)):
        if wanted:
            runs = runs.filter(F.col(column) == wanted)
    return runs


def filter_alerts(alerts: DataFrame, visible: DataFrame, status: str = "", severity: str = "") -> DataFrame:
    kept = alerts.join(visible.select("model_id"), "model_id", "left_semi")
    for column, wanted in (("status", status), ("severity", severity)):
        if wanted:
            kept = kept.filter(F.col(column) == wanted)
    return kept


def page(df: DataFrame, number: int, order: list[Column], size: int = S.PAGE_SIZE) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def recent(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(k)


def invalid_thresholds(thresholds: DataFrame) -> DataFrame:
    """Threshold rows whose lower band is not below the upper one, with the offending bands."""
    found = F.array_compact(F.array(
        F.when(F.col("psi_moderate") >= F.col("psi_high"), "psi"),
        F.when(F.col("jsd_moderate") >= F.col("jsd_high"), "jsd"),
        F.when(F.col("health_critical_threshold") >= F.col("health_warning_threshold"), "health")))
    return thresholds.withColumn("problems", F.array_join(found, ",")).filter(F.col("problems") != "")


def resolve_thresholds(models: DataFrame, profiles: DataFrame) -> DataFrame:
    """The model's own row, else the global row (model_id null), else the defaults; whole rows."""
    names = list(S.THRESHOLDS)
    own = profiles.filter(F.col("model_id").isNotNull()).select(
        "model_id", F.struct(*names).alias("_own"))
    row = profiles.filter(F.col("model_id").isNull()).select(*names).first()
    shared = F.struct(*[F.lit(float(row[k])).alias(k) for k in names]) if row else None
    defaults = F.struct(*[F.lit(float(v)).alias(k) for k, v in S.THRESHOLDS.items()])
    joined = models.select("model_id").join(own, "model_id", "left")
    source = F.when(F.col("_own").isNotNull(), "model").otherwise("default" if shared is None else "global")
    fallback = defaults if shared is None else shared
    return joined.select("model_id", source.alias("source"),
                         F.coalesce("_own", fallback).alias("t")).select(
        "model_id", "source", "t.*")


def active_baseline(models: DataFrame, versions: DataFrame, baselines: DataFrame) -> DataFrame:
    """The baseline linked to the ACTIVE version, else the model's newest one."""
    active = versions.filter(F.col("status") == "ACTIVE").select(
        "model_id", F.col("version_id").alias("active_version_id"))
    ranked = (baselines.join(active, "model_id", "left")
              .withColumn("linked", F.coalesce(
                  F.col("version_id") == F.col("active_version_id"), F.lit(False))))
    best = ranked.groupBy("model_id").agg(F.max_by(
        F.struct("baseline_id", "linked"), F.struct("linked", "created_at", "baseline_id")).alias("b"))
    return models.select("model_id").join(best, "model_id", "left").select(
        "model_id", "b.baseline_id", "b.linked")


def preflight(models: DataFrame, versions: DataFrame, baselines: DataFrame) -> DataFrame:
    """Why a model accepts no batch: inactive, no active version, or no baseline."""
    active = versions.filter(F.col("status") == "ACTIVE").select("model_id").distinct().withColumn(
        "_v", F.lit(True))
    based = baselines.select("model_id").distinct().withColumn("_b", F.lit(True))
    joined = models.join(active, "model_id", "left").join(based, "model_id", "left")
    name = F.concat(F.lit("'"), F.col("name"), F.lit("'"))
    reason = (
        F.when(~F.col("is_active"), F.concat(name, F.lit(" is deactivated and accepts no batches.")))
        .when(F.col("_v").isNull(), F.concat(
            name, F.lit(" has no active version. Upload and activate one first.")))
        .when(F.col("_b").isNull(), F.concat(name, F.lit(" has no baseline dataset."))))
    return joined.select("model_id", reason.alias("refusal_reason"))


def reference_accuracy(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Training accuracy, else the accuracy of the version's first labelled run, else null."""
    first = runs.filter("labels_available").groupBy("version_id").agg(
        F.min_by("accuracy", F.struct(*_RUN_ORDER)).alias("_first"))
    return versions.join(first, "version_id", "left").select(
        "version_id", F.coalesce("training_accuracy", "_first").alias("reference_accuracy"))


def latest_run(runs: DataFrame) -> DataFrame:
    return newest(runs.filter(F.col("status") == S.COMPLETED), ["model_id"], _RUN_ORDER)


def feature_history(results: DataFrame, k: int = 30) -> DataFrame:
    """A feature's last k results with their place, oldest first; a null key has no places."""
    keys = ["model_id", "feature"]
    last = newest(results, keys, _RUN_ORDER, k)
    # at most k rows per feature remain, and they lie together already
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*_RUN_ORDER)).cast("long")
    known = F.col("model_id").isNotNull() & F.col("feature").isNotNull()
    return last.withColumn("place", F.when(known, place))


def version_numbers(versions: DataFrame) -> DataFrame:
    numbered = positions(versions, ["model_id"], ["uploaded_at", "version_id"], out="version_number")
    return numbered.withColumn("label", F.concat(F.lit("V"), F.col("version_number").cast("string")))


def single_active_version(events: DataFrame) -> DataFrame:
    """The version of the last activation whose artifact did not fail validation."""
    return events.filter(F.col("validation_status") != S.FAILED).groupBy("model_id").agg(
        F.max_by("version_id", F.struct("activated_at", "version_id")).alias("version_id"),
        F.max("activated_at").alias("activated_at"))


def downsample(series: DataFrame, keys: list[str], order: list[str], slice_by: Column,
               max_points: int = S.MAX_POINTS) -> DataFrame:
    """At most max_points rows per key: rows floor(i*n/max) for i < max-1, and the newest row."""
    numbered = attach_positions(series, keys, order, slice_by)
    i, n = F.col("position") - 1, F.col("size")
    stride = n / F.lit(float(max_points))

    def hit(j: Column) -> Column:
        return (j < max_points - 1) & (F.floor(j * stride) == i)

    near = F.floor(i / stride)
    chosen = hit(near) | hit(near + 1)
    return numbered.filter((n <= max_points) | chosen | (i == n - 1)).drop("size")


def max_psi(runs: DataFrame, results: DataFrame) -> DataFrame:
    worst = results.groupBy("run_id").agg(F.bround(F.max("psi"), 4).alias("max_psi"))
    return runs.select("run_id").join(worst, "run_id", "left")


def performance_series(runs: DataFrame) -> DataFrame:
    """Chart series: positive-class metrics, macro where those are null or 0; gaps if unlabelled."""
    def pick(metric: str) -> Column:
        return F.when(F.col("labels_available"), F.coalesce(
            F.nullif(F.col(f"{metric}_positive"), F.lit(0.0)), F.col(f"{metric}_macro"))).alias(metric)

    return runs.select(
        "model_id", "run_id", X.time_label(F.col("created_at")).alias("label"),
        F.when(F.col("labels_available"), F.col("accuracy")).alias("accuracy"),
        pick("precision"), pick("recall"), pick("f1"))


def labelled_counts(series: DataFrame) -> DataFrame:
    return series.groupBy("model_id").agg(
        F.count("accuracy").alias("labelled_runs"),
        F.count_if(F.col("accuracy").isNull()).alias("unlabelled_runs"))


def drift_series(runs: DataFrame, results: DataFrame) -> DataFrame:
    clean = (F.col("features_total") - F.col("features_high") - F.col("features_moderate")
             - F.col("features_insufficient"))
    return runs.join(max_psi(runs, results), "run_id").select(
        "model_id", "run_id", F.col("features_high").alias("high"),
        F.col("features_moderate").alias("moderate"), clean.alias("clean"), "max_psi")


def health_series(runs: DataFrame) -> DataFrame:
    """Scores and bands with the limits in force at the model's newest run."""
    limits = runs.groupBy("model_id").agg(
        F.max_by(F.struct("health_warning_threshold", "health_critical_threshold"),
                 F.struct(*_RUN_ORDER)).alias("t")).select(
        "model_id", F.col("t.health_warning_threshold").alias("warning_at"),
        F.col("t.health_critical_threshold").alias("critical_at"))
    return runs.select("model_id", "run_id", "health_score", "health_band").join(limits, "model_id")


def prediction_mix_series(runs: DataFrame, mix: DataFrame) -> DataFrame:
    """Run x class share in percent, absent classes 0. Classes of a model are a short list."""
    per_run = mix.join(runs.select("run_id", "model_id"), "run_id")
    totals = per_run.groupBy("run_id").agg(F.sum("n").alias("total"))
    classes = per_run.select("model_id", "label").distinct()
    grid = runs.select("run_id", "model_id").join(classes, "model_id").select("model_id", "run_id", "label")
    return grid.join(per_run.select("run_id", "label", "n"), ["run_id", "label"], "left").join(
        totals, "run_id", "left").select(
        "model_id", "run_id", "label",
        F.bround(F.coalesce(100.0 * F.col("n") / F.col("total"), F.lit(0.0)), 2).alias("share"))


def compare_categories(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline and current share in percent of every category either side has."""
    totals = aligned.groupBy(*keys, "feature").agg(
        F.sum("n_baseline").alias("_b"), F.sum("n_current").alias("_c"))
    share = {"baseline_pct": ("n_baseline", "_b"), "current_pct": ("n_current", "_c")}
    return aligned.join(totals, [*keys, "feature"]).select(*keys, "feature", "category", *[
        F.bround(F.coalesce(F.try_divide(100.0 * F.col(n), F.col(t)), F.lit(0.0)), 2).alias(out)
        for out, (n, t) in share.items()])


def compare_bins(profile: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline and current counts per baseline bin, with its label."""
    base = F.broadcast(profile.select("feature", "bin_edges", F.col("bin_counts").alias("_base")))
    cells = F.arrays_zip(X.bin_labels(F.col("bin_edges")).alias("label"),
                         F.col("_base").alias("baseline"), F.col("bin_counts").alias("current"))
    return state.select(*keys, "feature", "bin_counts").join(base, "feature").select(
        *keys, "feature", F.posexplode(cells).alias("bin", "c")).select(
        *keys, "feature", "bin", "c.label", "c.baseline", "c.current")


def quality_checks(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Missing, duplicate and outlier rate against the limits of the run's own snapshot."""
    def check(i: int, label: str, measured: str, limit: str, penalty: str) -> Column:
        return F.struct(
            F.lit(i).alias("position"), F.lit(label).alias("label"),
            X.percent(F.col(measured), 2).alias("measured"),
            X.percent(F.col(limit) * 100.0, 2, "—").alias("threshold"),
            F.coalesce(F.col(penalty), F.lit(0.0)).alias("penalty"),
            F.coalesce(F.col(measured) <= F.col(limit) * 100.0, F.lit(True)).alias("passed"))

    rows = F.array(
        check(0, "Missing value rate", "missing_pct", "missing_value_rate_threshold", "penalty_missing"),
        check(1, "Duplicate row rate", "duplicate_pct", "duplicate_row_rate_threshold", "penalty_duplicates"),
        check(2, "Outlier rate", "outlier_pct", "outlier_rate_threshold", "penalty_outliers"))
    return reports.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*")


def summary_rows(baseline: DataFrame, current: DataFrame, keys: list[str], numeric: bool) -> DataFrame:
    """Baseline beside current, one row per statistic."""
    names = ([("mean", "Mean"), ("std", "Std deviation"), ("min", "Minimum"),
              ("q1", "25th percentile"), ("median", "Median"), ("q3", "75th percentile"),
              ("max", "Maximum"), ("missing_pct", "Missing %")] if numeric else
             [("n", "Rows"), ("n_unique", "Distinct values"), ("missing_pct", "Missing %")])
    base = F.broadcast(baseline.select(
        "feature", F.struct(*[F.col(c).cast("double").alias(c) for c, _ in names]).alias("_b")))
    rows = F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(label).alias("label"), F.col(f"_b.{c}").alias("baseline"),
        F.col(c).cast("double").alias("current")) for i, (c, label) in enumerate(names)])
    return current.join(base, "feature").select(*keys, "feature", F.explode(rows).alias("r")).select(
        *keys, "feature", "r.*")


def model_overview(models: DataFrame, runs: DataFrame, versions: DataFrame) -> DataFrame:
    """Models with latest run, active version, version count; worst health first by ``rank_score``."""
    last = latest_run(runs).select("model_id", "run_id", "health_score", "health_band")
    per = versions.groupBy("model_id").agg(
        F.count("*").alias("version_count"),
        F.max(F.when(F.col("status") == "ACTIVE", F.col("version_id"))).alias("active_version_id"))
    return models.select("model_id", "name").join(last, "model_id", "left").join(
        per, "model_id", "left").select(
        "model_id", "name", "run_id", "health_score", "active_version_id",
        F.coalesce("version_count", F.lit(0)).alias("version_count"),
        F.coalesce(F.col("health_band").isin(S.WARNING, S.CRITICAL), F.lit(False)).alias("needs_attention"),
        F.coalesce("health_score", F.lit(101)).alias("rank_score"))


def runs_wide(runs: DataFrame, performance: DataFrame, quality: DataFrame, versions: DataFrame) -> DataFrame:
    """Runs with their 1:1 children and version label; children a run lacks are null."""
    version = versions.select("version_id", F.col("label").alias("version_label"))
    return (runs.join(performance, "run_id", "left").join(quality, "run_id", "left")
            .join(version, "version_id", "left"))


def alerts_of_versions(alerts: DataFrame, runs: DataFrame) -> DataFrame:
    """Alerts with the version of the run they last point at."""
    return alerts.drop("version_id").join(runs.select("run_id", "version_id"), "run_id")


def grants_report(grants: DataFrame, users: DataFrame, models: DataFrame) -> DataFrame:
    """Who may do what on which model, and who granted it."""
    givers = users.select(F.col("user_id").alias("granted_by"), F.col("user_name").alias("giver"))
    return (grants.join(users, "user_id").join(models.select("model_id", "name"), "model_id")
            .join(givers, "granted_by", "left").select("user_name", "name", "permission", "giver"))


def version_stats(versions: DataFrame, runs: DataFrame, alerts: DataFrame) -> DataFrame:
    """Observed measures per version; null where nothing was measured."""
    done = runs.filter(F.col("status") == S.COMPLETED)
    labelled = F.col("labels_available")
    per = done.groupBy("version_id").agg(
        F.max_by("accuracy", F.struct(*_RUN_ORDER)).alias("latest_accuracy"),
        F.avg(F.when(labelled, F.col("accuracy"))).alias("mean_accuracy"),
        F.avg(F.when(labelled, F.col("f1_positive"))).alias("mean_f1"),
        F.avg(F.when(labelled, F.col("recall_positive"))).alias("mean_recall"),
        F.avg("health_score").alias("mean_health"), F.avg("features_high").alias("mean_high_drift"),
        F.count("*").alias("run_count"))
    raised = alerts_of_versions(alerts, runs).groupBy("version_id").agg(
        F.count("*").alias("alert_count"))
    return versions.select("version_id", "model_id", "label", "training_accuracy").join(
        per, "version_id", "left").join(raised, "version_id", "left").fillna(
        0, ["run_count", "alert_count"])


# measure, label, does more win (None: not compared)
COMPARED = [
    ("training_accuracy", "Training accuracy", True),
    ("latest_accuracy", "Latest accuracy", True),
    ("mean_accuracy", "Mean accuracy", True),
    ("mean_f1", "Mean F1 (positive class)", True),
    ("mean_recall", "Mean recall (positive class)", True),
    ("mean_health", "Mean health score", True),
    ("mean_high_drift", "Mean high-drift features", False),
    ("run_count", "Monitoring runs", None),
    ("alert_count", "Alerts raised", False),
]


def schema_compatible(left: Column, right: Column) -> Column:
    """Feature-name sets are equal, or one of them is unknown."""
    same = (F.size(F.array_except(left, right)) == 0) & (F.size(F.array_except(right, left)) == 0)
    empty = F.coalesce(F.size(left) <= 0, F.lit(True)) | F.coalesce(F.size(right) <= 0, F.lit(True))
    return empty | same


def version_comparison(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Measures of two versions side by side. ``pairs``: model_id, a_id, b_id, compatible."""
    measures = [m for m, _, _ in COMPARED]
    a = stats.select(F.col("version_id").alias("a_id"), F.struct("label", *measures).alias("a"))
    b = stats.select(F.col("version_id").alias("b_id"), F.struct("label", *measures).alias("b"))

    def row(i: int, name: str, label: str, more_wins: bool | None) -> Column:
        x, y = F.col(f"a.{name}").cast("double"), F.col(f"b.{name}").cast("double")
        decided = (x != y) if more_wins is not None else F.lit(False)
        a_wins = (x > y) if more_wins else (x < y)
        entry = F.struct(
            F.lit(i).alias("position"), F.lit(label).alias("measure"), x.alias("a_value"),
            y.alias("b_value"), F.when(decided, F.when(a_wins, "a").otherwise("b")).alias("winner"),
            F.when(decided, F.abs(x - y)).alias("delta"))
        return F.when(F.col("compatible"), entry) if name == "mean_high_drift" else entry

    rows = F.array_compact(F.array(*[row(i, *c) for i, c in enumerate(COMPARED)]))
    return pairs.join(a, "a_id").join(b, "b_id").select(
        "model_id", "a_id", "b_id", F.col("a.label").alias("a_label"),
        F.col("b.label").alias("b_label"), F.explode(rows).alias("r")).select(
        "model_id", "a_id", "b_id", "a_label", "b_label", "r.*")


def comparison_verdict(comparison: DataFrame) -> DataFrame:
    """One sentence per compared pair."""
    measure = F.col("measure")
    per = comparison.groupBy("model_id", "a_id", "b_id", "a_label", "b_label").agg(
        F.count_if(F.col("winner") == "a").alias("wins_a"),
        F.count_if(F.col("winner") == "b").alias("wins_b"), F.count("*").alias("rows"),
        F.sum(F.when(measure == "Monitoring runs", F.coalesce("a_value", F.lit(0.0))
                     + F.coalesce("b_value", F.lit(0.0)))).cast("long").alias("runs"),
        F.max(F.when(measure == "Mean accuracy", F.col("winner"))).alias("acc_winner"),
        F.max(F.when(measure == "Mean accuracy", F.col("delta"))).alias("acc_delta"))
    a_better = F.col("wins_a") > F.col("wins_b")
    side = F.when(a_better, "a").otherwise("b")
    detail = F.when(F.col("acc_delta").isNotNull(), F.concat(
        F.lit(", "), F.when(F.col("acc_winner") == side, "ahead on").otherwise("behind on"),
        F.lit(" mean accuracy by "), X.fixed(F.col("acc_delta") * 100.0, 1), F.lit(" points"))
    ).otherwise("")
    count, runs = F.col("rows").cast("string"), F.col("runs").cast("string")
    even = F.concat(F.col("a_label"), F.lit(" and "), F.col("b_label"),
                    F.lit(" are evenly matched across "), count, F.lit(" measures over "), runs,
                    F.lit(" runs."))
    better = F.concat(
        F.when(a_better, F.col("a_label")).otherwise(F.col("b_label")), F.lit(" outperforms "),
        F.when(a_better, F.col("b_label")).otherwise(F.col("a_label")), F.lit(" on "),
        F.greatest("wins_a", "wins_b").cast("string"), F.lit(" of "), count, F.lit(" measures"),
        detail, F.lit(", across "), runs, F.lit(" runs."))
    return per.select("model_id", "a_id", "b_id", F.when(
        F.col("wins_a") == F.col("wins_b"), even).otherwise(better).alias("verdict"))


def dashboard_counts(models: DataFrame, alerts: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Totals of the start page."""
    counted = {
        "total_models": models.agg(F.count("*").alias("n")),
        "unresolved_alerts": alerts.agg(
            F.count_if(F.col("status").isin("NEW", "ACKNOWLEDGED")).alias("n")),
        "open_recommendations": recommendations.agg(F.count_if(F.col("status") == "OPEN").alias("n"))}
    rows = None
    for name, one in counted.items():
        part = one.select(F.lit(name).alias("name"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in counted])


def active_users(logins: DataFrame, now: Column) -> DataFrame:
    """Distinct users with a successful login in the last 24 hours."""
    kept = logins.filter((F.col("event") == "LOGIN_SUCCESS")
                         & (F.col("occurred_at") >= now - F.expr("INTERVAL 1 DAYS")))
    return kept.agg(F.count_distinct("user_id").alias("active_users"))


def expired_batches(batches: DataFrame, now: Column, days: int = S.RETENTION_DAYS) -> DataFrame:
    """Batches whose stored file is past retention; selection only."""
    return batches.filter((F.col("received_at") < now - F.expr(f"INTERVAL {days} DAYS"))
                          & (F.coalesce("file", F.lit("")) != ""))


def minority_share(df: DataFrame, target: str) -> DataFrame:
    per = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("c"))
    return per.agg((F.min("c") / F.sum("c")).alias("minority_share"))


def missing_required(present: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """Long feeds: batches that lack a required feature, with the first eight names.

    ``present`` has keys and feature; ``required`` has feature, one row per monitored column.
    """
    names = sorted(r["feature"] for r in required.select("feature").distinct().collect())
    monitored = F.array(*[F.lit(n) for n in names])
    # at most one entry per monitored column
    seen = present.groupBy(*keys).agg(F.collect_set(
        F.when(F.col("feature").isin(names), F.col("feature"))).alias("_seen"))
    lacking = seen.withColumn("missing", F.array_except(monitored, "_seen"))
    return lacking.filter(F.size("missing") > 0).select(*keys, rejection_message(F.col("missing")).alias("message"))


def rejection_message(missing: Column) -> Column:
    return F.concat(
        F.lit("Batch is missing "), F.size(missing).cast("string"), F.lit(" required column(s): "),
        F.array_join(F.slice(missing, 1, 8), ", "), F.when(F.size(missing) > 8, "…").otherwise(""))


def history_export(runs: DataFrame, models: DataFrame) -> DataFrame:
    return runs.join(models.select("model_id", F.col("name").alias("model_name")), "model_id").select(
        F.col("run_id").alias("Run ID"), F.col("model_name").alias("Model"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.col("status").alias("Run Status"), F.col("drift_status").alias("Drift Status"),
        F.col("health_score").cast(T.LongType()).alias("Health Score"))
