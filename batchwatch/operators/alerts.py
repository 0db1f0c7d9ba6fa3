"""Alert rules, deduplication into alerts, and their lifecycle."""

# Fixed texts: the sentences in this module are part of the results and have to stay as they are.
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions.status import Thresholds, accuracy_drop
from ..storage import materialise
from .ordered import in_ranges, newest, previous_values, running_sums

_FIELDS = ["category", "feature", "severity", "rule_code", "headline", "message"]


def _alert(category: str, severity: str, rule: str, headline: Column | str, message: Column,
           feature: Column | None = None) -> Column:
    head = F.lit(headline) if isinstance(headline, str) else headline
    return F.struct(
        F.lit(category).alias("category"),
        (feature if feature is not None else F.lit("")).alias("feature"),
        F.lit(severity).alias("severity"), F.lit(rule).alias("rule_code"),
        head.alias("headline"), message.alias("message"))


def feature_alerts(results: DataFrame, keep: list[str]) -> DataFrame:
    """One occurrence per drifted feature of a run (status HIGH or MODERATE)."""
    name = F.col("feature")
    text = F.coalesce("explanation", F.concat(
        F.lit("PSI "), X.fixed(F.col("psi"), 3), F.lit(" exceeds the "), F.lower("status"),
        F.lit(" threshold.")))
    alert = F.when(F.col("status") == S.HIGH, _alert(
        "DRIFT", S.CRITICAL, "DRIFT_HIGH", F.concat(F.lit("High drift detected — "), name), text, name,
    )).when(F.col("status") == S.MODERATE, _alert(
        "DRIFT", S.WARNING, "DRIFT_MODERATE",
        F.concat(F.lit("Moderate drift detected — "), name), text, name))
    return (results.filter(F.col("status").isin(S.HIGH, S.MODERATE))
            .select(*keep, alert.alias("a")).select(*keep, "a.*").select(*keep, *_FIELDS))


def run_alerts(runs: DataFrame, keep: list[str], t: Thresholds) -> DataFrame:
    """Accuracy, quality and health rules: at most one occurrence of each per run.

    Needs accuracy, reference_accuracy, quality_score, health_score.
    """
    drop = accuracy_drop(F.col("accuracy"), F.col("reference_accuracy"))
    accuracy_text = F.concat(
        F.lit("Accuracy is "), X.fixed(F.col("accuracy"), 4), F.lit(", "), X.fixed(drop * 100.0, 1),
        F.lit(" points below the reference of "), X.fixed(F.col("reference_accuracy"), 4), F.lit("."))
    quality_text = F.concat(F.lit("Data quality scored "), F.col("quality_score").cast("string"),
                            F.lit("/100."))
    score = F.col("health_score")

    def health_text(level: str, limit: Column) -> Column:
        return F.concat(F.lit("Health score "), score.cast("string"), F.lit(f"/100, below the {level} threshold of "),
                        X.plain_number(limit), F.lit("."))

    performance = F.when(drop >= t["accuracy_drop_major"], _alert(
        "PERFORMANCE", S.CRITICAL, "PERFORMANCE_DROP_MAJOR", "Accuracy has fallen sharply",
        accuracy_text)).when(drop >= t["accuracy_drop_minor"], _alert(
            "PERFORMANCE", S.WARNING, "PERFORMANCE_DROP_MINOR", "Accuracy has fallen", accuracy_text))
    quality = F.when(F.col("quality_score") < S.POOR_QUALITY, _alert(
        "QUALITY", S.CRITICAL, "QUALITY_POOR", "Incoming data quality is poor", quality_text,
    )).when(F.col("quality_score") < S.DEGRADED_QUALITY, _alert(
        "QUALITY", S.WARNING, "QUALITY_DEGRADED", "Incoming data quality has degraded", quality_text))
    health = F.when(score < t["health_critical_threshold"], _alert(
        "HEALTH", S.CRITICAL, "HEALTH_CRITICAL", "Model health is critical",
        health_text("critical", t["health_critical_threshold"]),
    )).when(score < t["health_warning_threshold"], _alert(
        "HEALTH", S.WARNING, "HEALTH_WARNING", "Model health has degraded",
        health_text("healthy", t["health_warning_threshold"])))
    fired = F.array_compact(F.array(performance, quality, health))
    return runs.select(*keep, F.explode(fired).alias("a")).select(*keep, "a.*")


def system_alerts(batches: DataFrame, runs: DataFrame, keep: list[str]) -> DataFrame:
    """Rejected batches and failed runs. Both share the key (model, SYSTEM, '')."""
    rejected = batches.filter(F.col("status") == S.REJECTED).select(*keep, _alert(
        "SYSTEM", S.WARNING, "BATCH_REJECTED", "Batch rejected", F.col("message")).alias("a"))
    failed = runs.filter(F.col("status") == S.FAILED).select(*keep, _alert(
        "SYSTEM", S.CRITICAL, "RUN_FAILED",
        F.concat(F.lit("Monitoring run #"), F.col("run_id").cast("string"), F.lit(" failed")),
        F.col("message")).alias("a"))
    return rejected.unionByName(failed).select(*keep, "a.*").select(*keep, *_FIELDS)


def dedup_alerts(occurrences: DataFrame, keys: list[str], ts: str, tie: str,
                 cooldown_minutes: Column | float = 60.0,
                 resolutions: DataFrame | None = None) -> DataFrame:
    """Occurrences of one key whose gap is at most the cooldown form one alert.

    Texts come from the latest occurrence. A RESOLVED action (keys, ts) between two occurrences
    also starts a new alert. The island number of an occurrence is a running sum of starts; the
    starts are stored first, because the sum reads them twice.
    """
    cooldown = F.lit(float(cooldown_minutes)) if not isinstance(cooldown_minutes, Column) else cooldown_minutes
    extra = [c for c in occurrences.columns if c not in (*keys, ts, tie)]
    rows = occurrences.withColumn("_resolve", F.lit(0))
    if resolutions is not None:
        marks = resolutions.select(*keys, ts).withColumn("_resolve", F.lit(1))
        rows = rows.unionByName(marks, allowMissingColumns=True)
    rows, slice_by = in_ranges(rows, keys, [ts, "_resolve", tie]), F.col("_range")
    before = previous_values(
        rows, keys, [ts, "_resolve", tie], slice_by, {"_prev_ts": ts, "_prev_resolve": "_resolve"})
    if resolutions is not None:
        # the gap is measured to the previous occurrence; a resolution in between starts anew anyway
        gap_open = F.col("_prev_resolve") == 1
    else:
        gap_open = F.lit(False)
    starts = F.when(F.col("_resolve") == 1, 0).when(
        F.col("_prev_ts").isNull() | gap_open
        | ((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_prev_ts").cast("timestamp")))
           > cooldown * 60_000_000), 1).otherwise(0)
    started = materialise(before.withColumn("_start", starts.cast("long")).drop(
        "_prev_ts", "_prev_resolve"), "alert-starts")
    islands = running_sums(started, keys, [ts, "_resolve", tie], slice_by,
                           {"island": F.col("_start")}).filter(F.col("_resolve") == 0).drop("_range")
    latest = F.struct(ts, tie)
    return islands.groupBy(*keys, "island").agg(
        F.count("*").alias("occurrence_count"), F.min(ts).alias("first_seen_at"),
        F.max(ts).alias("last_seen_at"),
        *[F.max_by(c, latest).alias(c) for c in [tie, *extra]])


def auto_resolve(runs: DataFrame, alerts: DataFrame, warning: Column,
                 clean_runs: int = S.CLEAN_RUNS_TO_RESOLVE) -> DataFrame:
    """Health alerts of models whose newest ``clean_runs`` scored runs all reach the limit."""
    scored = runs.filter(F.col("health_score").isNotNull())
    recent = newest(scored, ["model_id"], ["created_at", "run_id"], clean_runs).groupBy(
        "model_id").agg(F.count("*").alias("c"), F.min("health_score").alias("lowest"))
    clean = recent.filter((F.col("c") == clean_runs) & (F.col("lowest") >= warning))
    return alerts.filter((F.col("category") == "HEALTH") & F.col("status").isin("NEW", "ACKNOWLEDGED")
                         ).join(clean.select("model_id"), "model_id", "left_semi").withColumn(
        "message", F.concat("message", F.lit(" [Auto-resolved — condition cleared]"))).withColumn(
        "status", F.lit("RESOLVED"))


def lifecycle_state(actions: DataFrame, key: str, ts: str, action: str, initial: str) -> DataFrame:
    """Current state per id: its last action, else the initial state."""
    return actions.groupBy(key).agg(
        F.coalesce(F.max_by(action, F.when(F.col(action).isNotNull(), F.col(ts))),
                   F.lit(initial)).alias("state"),
        F.count(action).alias("actions"))


def alerts_per_day(alerts: DataFrame, since: Column) -> DataFrame:
    """Alerts first seen per day, one column per severity, zero-filled."""
    kept = alerts.filter(F.col("first_seen_at") >= since)
    return kept.groupBy("model_id", F.to_date("first_seen_at").alias("day")).agg(*[
        F.count_if(F.col("severity") == s).alias(s.lower())
        for s in (S.INFO, S.WARNING, S.CRITICAL)])
