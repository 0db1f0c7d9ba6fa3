"""Streaming counterparts, run over all files that have arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.monitor import profile_baseline
from ..sources.sinks import read_children, read_runs
from ..storage import scratch
from ..streaming import monitor as M
from ..streaming import sources as St
from . import bindings as B
from . import drift as D
from . import sql as Q
from .bindings import rounded

_WATERMARK = "2 hours"


def _window_state(spark, sf, slide=None):
    profile = B.numeric_profile(B.events_baseline(spark, sf), ["value"])
    later = St.table_stream(spark, sf, "events").filter(f"ts >= {B._EVENTS_SPLIT}")
    return M.windowed_state(later, profile, ["value"], "ts", _WATERMARK, "1 day", slide)


def windowed_bin_counts(spark, sf):
    out = St.drain_to_table(M.windowed_drift(_window_state(spark, sf)), "windows")
    return rounded(_named(out).drop("window_start"), "psi", "jsd")


def sliding_bin_counts(spark, sf):
    out = St.drain_to_table(M.windowed_drift(_window_state(spark, sf, "12 hours")), "sliding")
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("started"), "n", "psi"), "psi")


def stream_quality(spark, sf):
    out = St.drain_to_table(M.windowed_quality(_window_state(spark, sf)), "quality")
    return _named(out).drop("window_start")


def _named(out):
    return out.withColumn("batch_id", F.date_format("window_start", "yyyy-MM-dd"))


def stream_alert_dedup(spark, sf):
    errors = St.table_stream(spark, sf, "events").filter("event_type = 'error'").selectExpr(
        "user_id AS model_id", "ts", "event_id")
    out = St.drain_to_table(
        M.stream_alert_dedup(errors, ["model_id"], "ts", "event_id", _WATERMARK, "24 hours"), "alerts")
    micros = [F.unix_micros(c).alias(c) for c in ("first_seen_at", "last_seen_at")]
    return out.select("model_id", "occurrence_count", *micros, "event_id")


def stream_consecutive(spark, sf):
    orders = St.table_stream(spark, sf, "orders")
    runs = orders.selectExpr(*[f"{B._RUN_COLUMNS[c]} AS {c}" for c in (
        "model_id", "run_id", "created_at", "health_score")])
    out = scratch(spark, "streaks")
    M.stream_consecutive(runs, "health_score", F.lit(60), out, scratch(spark, "streak-state"),
                         scratch(spark, "streak-checkpoint"))
    return spark.read.parquet(out).select("model_id", "run_id", "health_score", "alarm")


def stream_monitor(spark, sf):
    base = profile_baseline(B.events_baseline(spark, sf), B.EVENTS_NUMERIC, B.EVENTS_CATEGORICAL)
    mix = B.events_baseline(spark, sf).select(F.expr(D._RUN_RULE).alias("y_pred")).groupBy("y_pred").agg(
        F.count("*").alias("n"))
    later = St.table_stream(spark, sf, "events").filter(f"ts >= {B._EVENTS_SPLIT}").withColumn(
        "batch_id", F.date_format("ts", "yyyy-MM-dd")).selectExpr(
        "batch_id", "event_id", "ts", "user_id", f"{B._DRIFT_TYPE} AS event_type", f"{B._DRIFT_VALUE} AS value", "props")
    root = scratch(spark, "monitored")
    M.stream_monitor(later, base, ["batch_id"], F.expr(D._RUN_RULE), root, scratch(spark, "monitor-checkpoint"),
                     target="event_type", labels=["error", "view"], positive="error", baseline_mix=mix,
                     reference_accuracy=0.3)
    counts = read_children(spark, root, "feature_results").groupBy("batch_id").agg(
        F.count("*").alias("stored_features"))
    return rounded(read_runs(spark, root).join(counts, "batch_id").select(*D._RUN_COLUMNS, "stored_features"),
                   "accuracy", "mix_jsd")


def skip_rejected(spark, sf):
    lines = St.table_stream(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS batch_id", "concat('f', CAST(l_linenumber AS STRING)) AS feature", "l_quantity AS value")
    required = B.table(spark, sf, "lineitem").selectExpr(
        "concat('f', CAST(l_linenumber AS STRING)) AS feature").distinct()
    good, bad = scratch(spark, "accepted"), scratch(spark, "rejected")
    M.skip_rejected(lines, ["batch_id"], required, good, bad, scratch(spark, "skip-checkpoint"))
    accepted = spark.read.parquet(good).groupBy("batch_id").agg(F.count("*").alias("rows")).withColumn(
        "message", F.lit("accepted"))
    return spark.read.parquet(bad).select("batch_id", "message", F.lit(0).cast("long").alias("rows")).unionByName(
        accepted.select("batch_id", "message", "rows"))


QUERIES = {f.__name__: f for f in (
    windowed_bin_counts, sliding_bin_counts, stream_quality, stream_alert_dedup, stream_consecutive,
    stream_monitor, skip_rejected)}

_PLAIN = [B.EVENTS_SQL, *Q.numeric_drift(["value"])]
# a window is emitted once the watermark, two hours behind the newest event, has passed its end
_CLOSED = "CAST(batch_id AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOURS"
_SLIDING = f"""WITH base AS (SELECT * FROM events WHERE ts < {B._EVENTS_SPLIT}),
batch AS (SELECT strftime(st, '%Y-%m-%d %H:%M') AS batch_id, value FROM (
  SELECT value, unnest([time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2024-01-01'),
    time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2024-01-01') - INTERVAL 12 HOURS]) AS st FROM events WHERE ts >= {B._EVENTS_SPLIT})),
"""

ORACLES = {
    "windowed_bin_counts": Q.with_(*_PLAIN) + f"""SELECT batch_id, feature, n1 AS n, round(psi, 6) AS psi, round(jsd, 6) AS jsd
FROM nd WHERE {_CLOSED}""",
    "sliding_bin_counts": _SLIDING + ",\n".join(Q.numeric_drift(["value"])) + f"""
SELECT batch_id AS started, n1 AS n, round(psi, 6) AS psi FROM nd WHERE {_CLOSED}""",
    "stream_quality": Q.with_(B.EVENTS_SQL, *Q.drift(["value"], ["event_type"]),
                              *Q.quality(["value"], ["event_type"], "event_id, ts, user_id, event_type, value, props")) + f"""
SELECT batch_id, feature, rows, missing, missing_pct, below_min, above_max, outliers, outlier_pct FROM qc
WHERE feature = 'value' AND {_CLOSED}""",
    "stream_alert_dedup": Q.with_(B.OCCURRENCES_SQL, """f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 24 HOURS
  THEN 1 ELSE 0 END AS s FROM occ WINDOW w AS (PARTITION BY model_id ORDER BY ts, event_id))""",
        "i AS (SELECT *, sum(s) OVER (PARTITION BY model_id ORDER BY ts, event_id) AS island FROM f)") + """
SELECT model_id, count(*) AS occurrence_count, epoch_us(min(ts)) AS first_seen_at, epoch_us(max(ts)) AS last_seen_at,
  arg_max(event_id, (ts, event_id)) AS event_id FROM i GROUP BY model_id, island
HAVING max(ts) + INTERVAL 24 HOURS <= (SELECT max(ts) FROM occ) - INTERVAL 2 HOURS""",
    "stream_consecutive": Q.with_(B.RUNS_SQL) + """SELECT model_id, run_id, health_score,
  coalesce(health_score < 60 AND lag(health_score < 60) OVER w, false) AS alarm
FROM runs WHERE health_score IS NOT NULL WINDOW w AS (PARTITION BY model_id ORDER BY created_at, run_id)""",
    "stream_monitor": D.ORACLES["persist_run"],
    "skip_rejected": """WITH feed AS (SELECT DISTINCT l_orderkey AS batch_id, concat('f', l_linenumber) AS feature FROM lineitem),
req AS (SELECT DISTINCT feature FROM feed),
gaps AS (SELECT batch_id, list(feature ORDER BY feature) AS m FROM (
  SELECT b.batch_id, r.feature FROM (SELECT DISTINCT batch_id FROM feed) b CROSS JOIN req r
  EXCEPT SELECT batch_id, feature FROM feed) GROUP BY batch_id)
SELECT l.batch_id, coalesce(any_value(message), 'accepted') AS message, CASE WHEN any_value(message) IS NULL THEN count(*) ELSE 0 END AS rows
FROM (SELECT l_orderkey AS batch_id FROM lineitem) l LEFT JOIN (
  SELECT batch_id, concat('Batch is missing ', len(m), ' required column(s): ', array_to_string(m[1:8], ', '),
    CASE WHEN len(m) > 8 THEN '…' ELSE '' END) AS message FROM gaps) g USING (batch_id) GROUP BY l.batch_id""",
}
