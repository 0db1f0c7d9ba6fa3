"""From stored runs to alerts and retraining advice.

A commit of stored runs is turned into occurrences, which are merged into the alerts and recommendations that the
commit before it left. Every commit writes a version of its own and remembers its predecessor, so a repeated
commit starts from the same state and replaces its own files: the outcome is the same however often it runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.status import column_thresholds
from ..operators import alerts as A
from ..operators import retrain as R
from ..operators.ordered import in_ranges, previous_values, running_sums
from ..sources.sinks import read_children, read_runs
from ..storage import materialise

KEEP = ["model_id", "run_id", "created_at"]
ALERT_KEY = ["model_id", "category", "feature"]
_TEXTS = ["severity", "rule_code", "headline", "message", "run_id"]
ALERTS = ("model_id long, category string, feature string, number long, severity string, rule_code string, headline string, "
          "message string, run_id string, first_seen_at timestamp, last_seen_at timestamp, occurrence_count long, "
          "status string, cooldown double")
ADVICE = ("model_id long, number long, first_run_id string, run_id string, severity string, message string, "
          "opened_at timestamp, updated_at timestamp, updates long, status string")


@dataclass
class Version:
    """Alerts and recommendations as of a commit."""

    alerts: DataFrame
    advice: DataFrame


def _read(spark: SparkSession, root: str, table: str, commit: str | None, schema: str) -> DataFrame:
    if commit is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{table}/version={commit}")


def read_version(spark: SparkSession, root: str, commit: str | None) -> Version:
    return Version(_read(spark, root, "alerts", commit, ALERTS), _read(spark, root, "advice", commit, ADVICE))


def _parent(spark: SparkSession, root: str, commit: str) -> tuple[str | None, int]:
    """The version a commit continues and its place in the order: those of its first attempt, else the newest's."""
    from pyspark.errors import AnalysisException

    try:
        known = spark.read.schema("commit string, parent string, place int").parquet(f"{root}/versions")
        own = known.where(F.col("commit") == commit).first()
        if own:
            return own["parent"], own["place"]
        last = known.orderBy(F.desc("place")).first()
    except AnalysisException:
        last = None
    return (last["commit"], last["place"] + 1) if last else (None, 0)


def occurrences(spark: SparkSession, root: str, commit: str, keys: list[str]) -> DataFrame:
    """What the stored runs of a commit raise: KEEP, category, feature, severity, rule_code, headline, message, cooldown."""
    runs = read_runs(spark, root).where(F.col("commit").cast("string") == commit)
    features = read_children(spark, root, "feature_results").where(F.col("commit") == commit)
    features = features.join(runs.select(*dict.fromkeys([*keys, *KEEP])), keys)
    t = column_thresholds("thresholds")
    raised = A.feature_alerts(features, KEEP).unionByName(A.run_alerts(runs, KEEP, t))
    limits = runs.select("run_id", t["alert_cooldown_minutes"].alias("cooldown"))
    return raised.join(limits, "run_id")


def recommendations(spark: SparkSession, root: str, commit: str, names: DataFrame) -> DataFrame:
    """Runs of a commit that call for retraining; consecutive runs look back over the stored history of their models."""
    runs = read_runs(spark, root).withColumn("commit", F.col("commit").cast("string"))
    mine = runs.where(F.col("commit") == commit)
    history = runs.join(mine.select("model_id").distinct(), "model_id", "left_semi")
    for score, limit, out in (("health_score", F.col("thresholds.health_critical_threshold"), "health_critical_twice"),
                              ("quality_score", F.lit(float(S.POOR_QUALITY)), "quality_poor_twice")):
        flags = R.consecutive_below(history.select("model_id", "run_id", "created_at", score, "thresholds"), score, limit, out)
        mine = mine.join(flags.select("run_id", out), "run_id", "left").fillna(False, [out])
    triggered = R.retrain_triggers(mine, column_thresholds("thresholds")).join(names, "model_id", "left")
    return R.retrain_recommendations(triggered, F.coalesce("name", F.col("model_id").cast("string")))


def merge_advice(before: DataFrame, recommended: DataFrame) -> DataFrame:
    """At most one OPEN row per model: newer runs overwrite it, a closed one is followed by a new one."""
    latest = F.struct("created_at", "run_id")
    new = recommended.groupBy("model_id").agg(
        F.min_by("run_id", latest).alias("first_run_id"), F.max_by("run_id", latest).alias("run_id"),
        F.max_by("severity", latest).alias("severity"), F.max_by("message", latest).alias("message"),
        F.min("created_at").alias("opened_at"), F.max("created_at").alias("updated_at"), F.count("*").alias("updates"))
    last = before.groupBy("model_id").agg(F.max("number").alias("_last"))
    old = before.where("status = 'OPEN'").select(
        "model_id", F.col("number").alias("_n"), F.col("first_run_id").alias("_f"), F.col("opened_at").alias("_o"),
        F.col("updates").alias("_u"))
    merged = new.join(old, "model_id", "left").join(last, "model_id", "left").select(
        "model_id", F.coalesce("_n", F.coalesce("_last", F.lit(0)) + 1).alias("number"),
        F.coalesce("_f", "first_run_id").alias("first_run_id"), "run_id", "severity", "message",
        F.coalesce("_o", "opened_at").alias("opened_at"), "updated_at",
        (F.coalesce("_u", F.lit(0)) + F.col("updates")).alias("updates"), F.lit("OPEN").alias("status"))
    rest = before.join(merged.select("model_id", "number"), ["model_id", "number"], "left_anti")
    return rest.unionByName(merged)


def merge_alerts(before: DataFrame, raised: DataFrame) -> DataFrame:
    """Occurrences within the cooldown of an open alert's last one belong to it; others open alerts.

    An alert takes severity and texts of its latest occurrence. The open alert enters as one row that stands for all
    its occurrences, so a commit reads its own occurrences and the last alert of each key.
    """
    last = before.groupBy(*ALERT_KEY).agg(F.max("number").alias("number"))
    open_now = before.where("status <> 'RESOLVED'").join(last, [*ALERT_KEY, "number"], "left_semi").select(
        *ALERT_KEY, *_TEXTS, F.col("last_seen_at").alias("seen_at"), "first_seen_at", F.col("occurrence_count").alias("n"),
        "cooldown", F.col("number").alias("_number"), "status")
    new = raised.select(
        *ALERT_KEY, "severity", "rule_code", "headline", "message", F.col("run_id").cast("string").alias("run_id"),
        F.col("created_at").alias("seen_at"), F.col("created_at").alias("first_seen_at"), F.lit(1).cast("long").alias("n"),
        "cooldown", F.lit(None).cast("long").alias("_number"), F.lit(None).cast("string").alias("status"))
    touched = open_now.join(new.select(*ALERT_KEY).distinct(), ALERT_KEY, "left_semi").unionByName(new)
    order, by = ["seen_at", "run_id"], F.col("_range")
    apart = previous_values(in_ranges(touched, ALERT_KEY, order), ALERT_KEY, order, by, {"_before": "seen_at"})
    gap = F.unix_micros("seen_at") - F.unix_micros("_before")
    started = materialise(apart.withColumn("_start", F.when(
        F.col("_before").isNull() | (gap > F.col("cooldown") * 60_000_000), 1).otherwise(0).cast("long")).drop("_before"), "starts")
    islands = running_sums(started, ALERT_KEY, order, by, {"_island": F.col("_start")})
    latest = F.struct(*order)
    found = islands.groupBy(*ALERT_KEY, "_island").agg(
        *[F.max_by(c, latest).alias(c) for c in (*_TEXTS, "cooldown")], F.min("first_seen_at").alias("first_seen_at"),
        F.max("seen_at").alias("last_seen_at"), F.sum("n").alias("occurrence_count"),
        F.max("_number").alias("_number"), F.max("status").alias("status"))
    # the first island continues the open alert if it holds it; numbers go on from the last alert of the key
    opened = found.groupBy(*ALERT_KEY).agg(F.max("_number").alias("_open"))
    numbered = found.join(opened, ALERT_KEY).join(last.withColumnRenamed("number", "_last"), ALERT_KEY, "left").withColumn(
        "number", F.coalesce("_number", F.coalesce("_last", F.lit(0)) + F.col("_island")
                             - F.when(F.col("_open").isNotNull(), 1).otherwise(0))).withColumn(
        "status", F.coalesce("status", F.lit("NEW")))
    merged = numbered.select(*[c.split()[0] for c in ALERTS.split(", ")])
    rest = before.join(merged.select(*ALERT_KEY, "number"), [*ALERT_KEY, "number"], "left_anti")
    return rest.unionByName(merged)


def raise_alerts(spark: SparkSession, root: str, commit: str, keys: list[str], names: DataFrame) -> Version:
    """Alerts and advice after a commit of stored runs.

    The stored runs need model_id, run_id (text) and created_at besides ``keys``; ``names`` is (model_id, name). Run it
    after ``persist_runs`` of the same commit, commits in order. ``versions`` is written last.
    """
    parent, place = _parent(spark, root, commit)
    before = read_version(spark, root, parent)
    recommended = materialise(recommendations(spark, root, commit, names), "recommended")
    advice = materialise(merge_advice(before.advice, recommended), "advice")
    fresh = advice.where("status = 'OPEN'").join(before.advice.select("model_id", "number"), ["model_id", "number"], "left_anti")
    called = _called(fresh, recommended, names)
    raised = occurrences(spark, root, commit, keys)
    cooldowns = raised.groupBy("model_id").agg(F.max("cooldown").alias("cooldown"))
    raised = materialise(raised.unionByName(called.join(cooldowns, "model_id", "left").fillna(
        S.THRESHOLDS["alert_cooldown_minutes"], ["cooldown"])), "raised")
    alerts = materialise(merge_alerts(before.alerts, raised), "alerts")

    runs = read_runs(spark, root)
    warning = F.col("thresholds.health_warning_threshold")
    clean = A.auto_resolve(runs.withColumn("health_score", F.when(F.col("health_score").isNotNull(), F.col("health_score") - warning)),
                           alerts, F.lit(0.0))
    settled = alerts.join(clean.select(*ALERT_KEY, "number"), [*ALERT_KEY, "number"], "left_anti").unionByName(clean)
    advice.write.mode("overwrite").parquet(f"{root}/advice/version={commit}")
    settled.write.mode("overwrite").parquet(f"{root}/alerts/version={commit}")
    spark.createDataFrame([(commit, parent, place)], "commit string, parent string, place int").write.mode(
        "overwrite").parquet(f"{root}/versions/of={commit}")
    return read_version(spark, root, commit)


def _called(fresh: DataFrame, recommended: DataFrame, names: DataFrame) -> DataFrame:
    """One occurrence for every newly opened recommendation, with its first message."""
    named = fresh.join(names, "model_id", "left")
    raised = R.recommendation_alerts(named, recommended, F.coalesce("name", F.col("model_id").cast("string")))
    return raised.withColumnRenamed("seen_at", "created_at")
