"""How the operators are bound to the given tables, as DataFrames and as SQL for the checks.

Expressions used on both sides are written once, in the part of SQL both engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.categories import CategoryBaseline, category_baseline
from ..operators.profile import profile_categories, profile_numeric, stored_profile
from ..operators.rank_index import RankIndex, rank_index
from ..storage import materialise


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


# ── events: first ten days against every later day ─────────────────────────────────────────────
EVENTS_NUMERIC, EVENTS_CATEGORICAL = ["value"], ["event_type", "props"]
_EVENTS_SPLIT = "TIMESTAMP '2024-01-11 00:00:00'"
# drifted variant: part of the rows shifted from the 21st, a renamed category and gaps from the 26th
_DRIFT_VALUE = (
    "CASE WHEN batch_id >= '2024-01-26' AND event_type = 'signup' THEN NULL "
    "WHEN batch_id >= '2024-01-21' AND event_type IN ('error', 'click') THEN value + 100.0 "
    "ELSE value END")
_DRIFT_TYPE = (
    "CASE WHEN batch_id >= '2024-01-26' AND event_type = 'purchase' THEN 'refund' "
    "ELSE event_type END")


def events_baseline(spark, sf) -> DataFrame:
    return table(spark, sf, "events").filter(f"ts < {_EVENTS_SPLIT}")


def events_batches(spark, sf) -> DataFrame:
    return table(spark, sf, "events").filter(f"ts >= {_EVENTS_SPLIT}").withColumn(
        "batch_id", F.date_format("ts", "yyyy-MM-dd"))


def events_drifted(spark, sf) -> DataFrame:
    return events_batches(spark, sf).selectExpr(
        "batch_id", "event_id", "ts", "user_id", f"{_DRIFT_TYPE} AS event_type",
        f"{_DRIFT_VALUE} AS value", "props")


EVENTS_SQL = f"""base AS (SELECT * FROM events WHERE ts < {_EVENTS_SPLIT}),
batch AS (SELECT strftime(ts, '%Y-%m-%d') AS batch_id, * FROM events WHERE ts >= {_EVENTS_SPLIT})"""
EVENTS_DRIFTED_SQL = f"""base AS (SELECT * FROM events WHERE ts < {_EVENTS_SPLIT}),
plain AS (SELECT strftime(ts, '%Y-%m-%d') AS batch_id, * FROM events WHERE ts >= {_EVENTS_SPLIT}),
batch AS (SELECT batch_id, event_id, ts, user_id, {_DRIFT_TYPE} AS event_type,
  {_DRIFT_VALUE} AS value, props FROM plain)"""

# ── lineitem: the first year against every later year ──────────────────────────────────────────
LINES_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]
LINES_CATEGORICAL = ["l_tax", "l_returnflag", "l_linestatus"]
LINES_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]


def lines_baseline(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").filter("l_shipdate < TIMESTAMP '1996-01-01 00:00:00'")


def lines_batches(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").filter(
        "l_shipdate >= TIMESTAMP '1996-01-01 00:00:00'").withColumn(
        "batch_id", F.year("l_shipdate").cast("string"))


LINES_SQL = """base AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00'),
batch AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS batch_id, * FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00')"""

# ── documents and labels: predictions by rule, truth partly known ──────────────────────────────
PREDICTION_RULE = "CASE WHEN n_chars > 1500 THEN '1' ELSE '0' END"
CLASSES, POSITIVE = ["0", "1"], "1"


def scored_documents(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("y_true"))
    scored = docs.selectExpr("doc_id", "source AS batch_id", "n_chars", f"{PREDICTION_RULE} AS y_pred")
    return scored.join(labels, "doc_id", "left")


SCORED_SQL = f"""scored AS (SELECT d.doc_id, d.source AS batch_id, d.n_chars, {PREDICTION_RULE} AS y_pred,
  CAST(l.quality AS VARCHAR) AS y_true FROM documents d LEFT JOIN labels l USING (doc_id))"""

# ── a run history derived from orders; versions, baselines, grants and alerts around it ─────────
_DIGIT = "CAST(substr(o_orderpriority, 1, 1) AS BIGINT)"


def _cents(divisor: int, modulus: int) -> str:
    return f"(CAST(floor(o_totalprice / {divisor}) AS BIGINT) % {modulus})"


def _share(divisor: int) -> str:
    return f"(CAST({_cents(divisor, 1000)} AS DOUBLE) / 1000)"


_RUN_COLUMNS = {
    "run_id": "o_orderkey",
    "model_id": "o_custkey",
    "version_id": f"o_custkey * 10 + {_DIGIT}",
    "created_at": "o_orderdate",
    "status": "CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'COMPLETED' END",
    "trigger_source": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'UPLOAD' "
                      "WHEN o_orderpriority = '2-HIGH' THEN 'SCHEDULED' "
                      "WHEN o_orderpriority = '3-MEDIUM' THEN 'API' ELSE 'MANUAL' END",
    "features_total": "CAST(10 AS BIGINT)",
    "features_high": _cents(1, 3),
    "features_moderate": _cents(10, 4),
    "features_insufficient": _cents(100, 2),
    "drift_status": f"CASE WHEN {_cents(1, 3)} > 0 THEN 'HIGH' WHEN {_cents(10, 4)} > 0 THEN 'MODERATE' ELSE 'NONE' END",
    "health_score": f"CASE WHEN o_orderstatus <> 'P' THEN {_cents(7, 101)} END",
    "quality_score": f"CASE WHEN o_orderstatus <> 'P' THEN {_cents(13, 101)} END",
    "labels_available": "(o_orderstatus = 'F')",
    "accuracy": f"CASE WHEN o_orderstatus = 'F' THEN {_share(3)} END",
    "precision_positive": f"CASE WHEN o_orderstatus = 'F' AND {_cents(3, 4)} > 0 THEN CAST({_cents(11, 5)} AS DOUBLE) / 4 END",
    "recall_positive": f"CASE WHEN o_orderstatus = 'F' THEN {_share(17)} END",
    "f1_positive": f"CASE WHEN o_orderstatus = 'F' THEN {_share(19)} END",
    "precision_macro": f"CASE WHEN o_orderstatus = 'F' THEN {_share(23)} END",
    "recall_macro": f"CASE WHEN o_orderstatus = 'F' THEN {_share(29)} END",
    "f1_macro": f"CASE WHEN o_orderstatus = 'F' THEN {_share(31)} END",
    "health_warning_threshold": f"CAST(75 + {_cents(37, 10)} AS DOUBLE)",
    "health_critical_threshold": f"CAST(55 + {_cents(41, 10)} AS DOUBLE)",
    "message": "concat('stage ', o_orderpriority)",
}
_BAND = ("CASE WHEN health_score >= 80 THEN 'HEALTHY' WHEN health_score >= 60 THEN 'WARNING' "
         "WHEN health_score IS NOT NULL THEN 'CRITICAL' END")


def runs(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        *[f"{e} AS {c}" for c, e in _RUN_COLUMNS.items()]).selectExpr("*", f"{_BAND} AS health_band")


RUNS_SQL = ("runs AS (SELECT *, " + _BAND + " AS health_band FROM (SELECT "
            + ", ".join(f"{e} AS {c}" for c, e in _RUN_COLUMNS.items()) + " FROM orders))")

_MODEL_COLUMNS = {"model_id": "c_custkey", "name": "c_name", "owner_id": "CAST(c_nationkey AS BIGINT)",
                  "is_active": "(c_acctbal >= 0)"}


def models(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(*[f"{e} AS {c}" for c, e in _MODEL_COLUMNS.items()])


MODELS_SQL = "models AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _MODEL_COLUMNS.items()) + " FROM customer)"

_VERSIONS = """SELECT version_id, model_id, uploaded_at,
  CASE WHEN digit <= 2 THEN 0.5 + CAST(model_id % 50 AS DOUBLE) / 100 END AS training_accuracy,
  CASE WHEN digit = 3 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status,
  CASE WHEN digit = 5 THEN 'FAILED' ELSE 'PASSED' END AS validation_status,
  concat('V', CAST(digit AS VARCHAR(9))) AS label
FROM (SELECT version_id, model_id, version_id % 10 AS digit, min(created_at) AS uploaded_at
  FROM {runs} GROUP BY version_id, model_id) v"""
_BASELINES = """SELECT min(run_id) AS baseline_id, model_id, version_id, min(created_at) AS created_at
FROM {runs} WHERE status = 'COMPLETED' AND labels_available GROUP BY model_id, version_id"""
_FEATURES = """SELECT r.model_id, r.run_id, r.created_at,
  concat('f', CAST(l_linenumber AS VARCHAR(9))) AS feature, l_discount * 3 AS psi, l_tax * 2 AS jsd,
  CASE WHEN l_discount * 3 > 0.25 THEN 'HIGH' WHEN l_discount * 3 >= 0.1 THEN 'MODERATE'
    WHEN l_tax > 0.06 THEN 'INSUFFICIENT_DATA' ELSE 'NONE' END AS status,
  l_tax AS p_value, l_quantity AS test_statistic, l_returnflag AS feature_type,
  CAST(NULL AS VARCHAR(9)) AS explanation, l_suppkey AS line_key
FROM {lineitem} l JOIN {runs} r ON l_orderkey = r.run_id"""
_ALERTS = """SELECT r.model_id, r.run_id, r.version_id,
  CASE WHEN l_returnflag = 'R' THEN 'CRITICAL' WHEN l_returnflag = 'A' THEN 'WARNING' ELSE 'INFO' END AS severity,
  CASE WHEN l_linestatus = 'F' THEN 'RESOLVED' WHEN l_linenumber > 5 THEN 'ACKNOWLEDGED' ELSE 'NEW' END AS status,
  CASE WHEN l_linenumber <= 2 THEN 'HEALTH' WHEN l_linenumber <= 4 THEN 'DRIFT' ELSE 'QUALITY' END AS category,
  l_shipdate AS first_seen_at, l_partkey AS alert_key, l_linenumber AS line, 'raised' AS message
FROM {lineitem} l JOIN {runs} r ON l_orderkey = r.run_id"""
_GRANTS = """SELECT DISTINCT l_suppkey % 25 AS user_id, o_custkey AS model_id,
  CASE WHEN l_linenumber <= 3 THEN 'VIEW' ELSE 'MANAGE' END AS permission, l_suppkey % 7 AS granted_by
FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey"""


def _spark_sql(spark, text: str, **frames: DataFrame) -> DataFrame:
    return spark.sql(text, **frames)


def versions(spark, sf) -> DataFrame:
    return _spark_sql(spark, _VERSIONS, runs=runs(spark, sf))


def baselines(spark, sf) -> DataFrame:
    return _spark_sql(spark, _BASELINES, runs=runs(spark, sf))


def feature_results(spark, sf) -> DataFrame:
    return _spark_sql(spark, _FEATURES, lineitem=table(spark, sf, "lineitem"), runs=runs(spark, sf))


def alerts(spark, sf) -> DataFrame:
    return _spark_sql(spark, _ALERTS, lineitem=table(spark, sf, "lineitem"), runs=runs(spark, sf))


def grants(spark, sf) -> DataFrame:
    return _spark_sql(spark, _GRANTS, lineitem=table(spark, sf, "lineitem"), orders=table(spark, sf, "orders"))


_NAMES = {"runs": "runs", "lineitem": "lineitem", "orders": "orders"}
VERSIONS_SQL = f"versions AS ({_VERSIONS.format(**_NAMES)})"
BASELINES_SQL = f"baselines AS ({_BASELINES.format(**_NAMES)})"
FEATURES_SQL = f"feature_results AS ({_FEATURES.format(**_NAMES)})"
ALERTS_SQL = f"alerts AS ({_ALERTS.format(**_NAMES)})"
GRANTS_SQL = f"grants AS ({_GRANTS.format(**_NAMES)})"

# ── alert occurrences: error events per user ───────────────────────────────────────────────────
_OCCURRENCES = """SELECT user_id AS model_id, ts, event_id,
  CASE WHEN value > 50 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, props AS message
FROM {events} WHERE event_type = 'error'"""


def occurrences(spark, sf) -> DataFrame:
    return _spark_sql(spark, _OCCURRENCES, events=table(spark, sf, "events"))


OCCURRENCES_SQL = f"occ AS ({_OCCURRENCES.format(events='events')})"


# ── profiles, prepared once per query ──────────────────────────────────────────────────────────
def reference(base: DataFrame, features: list[str]) -> RankIndex:
    return rank_index(base, features)


def profiled(base: DataFrame, numeric: list[str], categorical: list[str],
             index: RankIndex | None = None) -> tuple[DataFrame, CategoryBaseline]:
    return numeric_profile(base, numeric, index), category_profile(base, categorical)


def numeric_profile(base: DataFrame, numeric: list[str], index: RankIndex | None = None) -> DataFrame:
    return stored_profile(profile_numeric(base, numeric, index=index))


def category_counts(base: DataFrame, categorical: list[str]) -> DataFrame:
    return materialise(profile_categories(base, categorical), "profile-categories")


def category_profile(base: DataFrame, categorical: list[str]) -> CategoryBaseline:
    return category_baseline(category_counts(base, categorical))
