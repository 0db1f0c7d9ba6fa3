"""The scalar rules, one query each, over the run history and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import status as St
from ..operators import history as H
from ..operators import performance as P
from ..operators import profile as Pr
from ..operators.longform import category_long
from . import bindings as B
from . import sql as Q
from .bindings import rounded

_A, _B = Q.band("l_discount * 3", 0.10, 0.25), Q.band("l_tax * 3", 0.10, 0.20)
_NAMES = "['NONE', 'MODERATE', 'HIGH']"


def _bands(spark, sf):
    t = St.literal_thresholds()
    return B.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        St.band(F.col("l_discount") * 3, t["psi_moderate"], t["psi_high"]).alias("a"),
        St.band(F.col("l_tax") * 3, t["jsd_moderate"], t["jsd_high"]).alias("b"))


def worst_status(spark, sf):
    return _bands(spark, sf).withColumn("worst", St.worst_status(F.col("a"), F.col("b"))).drop("a", "b")


def downgrade(spark, sf):
    return _bands(spark, sf).withColumn("lowered", St.downgrade(F.col("a"))).drop("a", "b")


def clamp(spark, sf):
    return B.runs(spark, sf).select("run_id", St.clamp(F.col("quality_score") * 3 - 100).alias("clamped"))


def performance_component(spark, sf):
    runs = B.runs(spark, sf).join(H.reference_accuracy(B.versions(spark, sf), B.runs(spark, sf)), "version_id")
    return rounded(runs.select("run_id", St.performance_component(
        F.col("accuracy"), F.col("reference_accuracy")).alias("component")), "component")


def drift_component(spark, sf):
    return B.runs(spark, sf).select("run_id", St.drift_component(
        F.col("features_high") * 3, F.col("features_moderate")).alias("component"))


def health_band(spark, sf):
    return B.runs(spark, sf).filter("health_score IS NOT NULL").select(
        "run_id", St.health_band(F.col("health_score")).alias("band"))


def coherence_cap(spark, sf):
    return B.runs(spark, sf).filter("health_score IS NOT NULL").select(
        "run_id", St.coherence_cap(F.col("health_score"), F.col("drift_status")).alias("score"))


def health_weights(spark, sf):
    return B.runs(spark, sf).select("run_id", St.health_weights(F.col("labels_available")).alias("w")).select(
        "run_id", "w.performance", "w.drift", "w.quality", "w.stability")


def prediction_rows(spark, sf):
    """Class, count and share of every batch's predictions."""
    scored = B.scored_documents(spark, sf)
    counts = P.outcome_counts(scored, ["batch_id"], "y_true", "y_pred")
    rows = P.prediction_distribution(counts, ["batch_id"], B.CLASSES)
    return rounded(rows.select("batch_id", "label", "n", "share"), "share")


def summary_rows_categorical(spark, sf):
    base = Pr.categorical_summary(category_long(B.lines_baseline(spark, sf), B.LINES_CATEGORICAL, []), ["feature"])
    cur = Pr.categorical_summary(
        category_long(B.lines_batches(spark, sf), B.LINES_CATEGORICAL, ["batch_id"]), ["batch_id", "feature"])
    return H.summary_rows(base, cur, ["batch_id"], False)


QUERIES = {f.__name__: f for f in (
    worst_status, downgrade, clamp, performance_component, drift_component, health_band, coherence_cap,
    health_weights, prediction_rows, summary_rows_categorical)}

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_REFERENCE = """refacc AS (SELECT v.version_id, coalesce(v.training_accuracy, f.accuracy) AS reference_accuracy
  FROM versions v LEFT JOIN (SELECT version_id, min_by(accuracy, (created_at, run_id)) AS accuracy
    FROM runs WHERE labels_available GROUP BY version_id) f USING (version_id))"""
_CATS = [B.LINES_SQL, Q.category_rows("blc", "base", B.LINES_CATEGORICAL),
         Q.category_rows("clc", "batch", B.LINES_CATEGORICAL, "batch_id, "), Q.CATEGORY_COUNTS]

ORACLES = {
    "worst_status": f"SELECT {_LINE}, {_NAMES}[greatest({_A}, {_B}) + 1] AS worst FROM lineitem",
    "downgrade": f"SELECT {_LINE}, {_NAMES}[greatest({_A} - 1, 0) + 1] AS lowered FROM lineitem",
    "clamp": Q.with_(B.RUNS_SQL) + """SELECT run_id, CASE WHEN quality_score IS NOT NULL
  THEN CAST(greatest(0, least(100, quality_score * 3 - 100)) AS DOUBLE) END AS clamped FROM runs""",
    "performance_component": Q.with_(B.RUNS_SQL, B.VERSIONS_SQL, _REFERENCE) + """SELECT run_id, round(CASE WHEN accuracy IS NULL THEN NULL
  WHEN reference_accuracy IS NULL THEN 100.0 ELSE greatest(0.0, 100 - 200 * greatest(0.0, reference_accuracy - accuracy)) END, 6) AS component
FROM runs JOIN refacc USING (version_id)""",
    "drift_component": Q.with_(B.RUNS_SQL) + """SELECT run_id, CAST(greatest(0, 100 - 45 * features_high - 6 * features_moderate) AS DOUBLE) AS component FROM runs""",
    "health_band": Q.with_(B.RUNS_SQL) + """SELECT run_id, CASE WHEN health_score >= 80 THEN 'HEALTHY' WHEN health_score >= 60 THEN 'WARNING' ELSE 'CRITICAL' END AS band
FROM runs WHERE health_score IS NOT NULL""",
    "coherence_cap": Q.with_(B.RUNS_SQL) + """SELECT run_id, CASE WHEN drift_status = 'HIGH' THEN least(health_score, 79) ELSE health_score END AS score
FROM runs WHERE health_score IS NOT NULL""",
    "health_weights": Q.with_(B.RUNS_SQL) + """SELECT run_id, CASE WHEN labels_available THEN 40.0 ELSE 0.0 END AS performance,
  CASE WHEN labels_available THEN 30.0 ELSE 50.0 END AS drift, CASE WHEN labels_available THEN 20.0 ELSE 35.0 END AS quality,
  CASE WHEN labels_available THEN 10.0 ELSE 15.0 END AS stability FROM runs""",
    "prediction_rows": f"""WITH {B.SCORED_SQL}, s AS (SELECT batch_id, count(*) AS total FROM scored GROUP BY batch_id)
SELECT s.batch_id, label, count(y_pred) AS n, round(count(y_pred) / any_value(total), 6) AS share
FROM s CROSS JOIN (VALUES ('0'), ('1')) l(label) LEFT JOIN scored d ON y_pred = label AND d.batch_id = s.batch_id
GROUP BY s.batch_id, label""",
    "summary_rows_categorical": Q.with_(*_CATS) + " UNION ALL ".join(
        f"SELECT cs.batch_id, cs.feature, {i} AS position, '{label}' AS label, CAST({b} AS DOUBLE) AS baseline, CAST({c} AS DOUBLE) AS current "
        "FROM cs JOIN bs USING (feature)"
        for i, (label, b, c) in enumerate((("Rows", "n0", "n1"), ("Distinct values", "k0", "k1"), ("Missing %", "0.0", "0.0")))),
}
