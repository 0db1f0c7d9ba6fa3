"""Sources, schema work and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.values import as_number
from ..operators import history as H
from ..operators import inference as I
from ..operators import profile as P
from ..operators import sampling as SA
from ..operators.categories import baseline_shares
from ..operators.longform import category_long, numeric_long
from ..operators.performance import labels_available, outcome_counts
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.arrivals import admit_files
from ..storage import scratch
from . import bindings as B
from . import sql as Q
from .bindings import rounded, table

_NOW = "TIMESTAMP '2001-01-01 00:00:00'"
_SOURCE = ("CASE WHEN batch_id < '2024-01-16' THEN 'UPLOAD' WHEN batch_id < '2024-01-21' THEN 'SIMULATOR' "
           "WHEN batch_id < '2024-01-26' THEN 'API' ELSE 'OTHER' END")
_FILE = "CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat('batch-', CAST(o_orderkey AS VARCHAR(20))) END"
_ORDER_FIELDS = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType())])


def read_table(spark, sf):
    path = scratch(spark, "orders") + ".csv"
    table(spark, sf, "orders").select(*_ORDER_FIELDS.names).write.option("header", True).csv(path)
    return R.read_table(spark, path, _ORDER_FIELDS)


def baseline_check(spark, sf):
    parts = [R.baseline_check(table(spark, sf, name), target).select(F.lit(name).alias("name"), "*")
             for name, target in (("events", "event_type"), ("orders", "o_orderstatus"),
                                  ("region", "r_name"), ("labels", "quality"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _check_sql(name: str, target: str) -> str:
    return f"""SELECT '{name}' AS name, row_count, target_values, reasons = '' AS accepted, reasons FROM (
SELECT *, concat_ws('; ', CASE WHEN row_count < 100 THEN 'fewer than 100 rows' END,
  CASE WHEN target_values < 2 THEN 'target has fewer than two distinct values' END) AS reasons
FROM (SELECT count(*) AS row_count, count(DISTINCT {target}) AS target_values FROM {name}))"""


def reference_sample(spark, sf):
    return SA.reference_sample(B.events_baseline(spark, sf), B.EVENTS_NUMERIC, ["event_id"])


def load_reference(spark, sf):
    path = scratch(spark, "reference")
    K.write_reference_sample(reference_sample(spark, sf), path)
    return R.load_reference(spark, path, f"{sf}/events.parquet")


_SAMPLE_SQL = f"""WITH {B.EVENTS_SQL}
SELECT event_id, value FROM base ORDER BY md5(concat_ws('|', '42', CAST(event_id AS VARCHAR))) LIMIT {S.REFERENCE_CAP}"""


def ingest_batches(spark, sf):
    rows = B.events_batches(spark, sf)
    return R.ingest_batches(rows, ["batch_id"], F.expr(_SOURCE), "value", F.col("ts"))


def history_export(spark, sf):
    export = H.history_export(B.runs(spark, sf), B.models(spark, sf))
    path = scratch(spark, "history")
    K.write_history_csv(export, path)
    return spark.read.schema(export.schema).option("header", True).csv(path)


def clean_multi_file(spark, sf):
    customers = table(spark, sf, "customer")
    line = F.concat_ws(", ", "c_custkey", F.when(F.col("c_acctbal") < 0, "?").otherwise(F.col("c_name")),
                       "c_nationkey", F.concat("c_mktsegment", F.lit(".")))
    first, second = scratch(spark, "raw-a"), scratch(spark, "raw-b")
    customers.filter("c_nationkey < 12").select(line).write.text(first)
    comment = customers.limit(1).select(F.lit("|1x3 Cross validator").alias("line"))
    comment.union(customers.filter("c_nationkey >= 12").select(line)).write.text(second)
    raw = R.read_raw_parts(spark, [(first, False), (second, True)], ["key", "name", "weight", "label"])
    return R.clean_parts(raw, ["weight"], "label")


def clean_coerce(spark, sf):
    text = table(spark, sf, "events").select("event_id", F.when(
        F.col("event_type") == "view", F.lit(" ")).otherwise(F.col("value").cast("string")).alias("charge"))
    return R.coerce_numbers(text, "charge").select("event_id", "charge", "charge_blank")


def blank_count(spark, sf):
    return clean_coerce(spark, sf).agg(
        F.count("*").alias("row_count"), F.count_if("charge_blank").alias("blanks"))


def expired_batches(spark, sf):
    batches = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS batch_id", "o_orderdate AS received_at", f"{_FILE} AS file")
    return H.expired_batches(batches, F.expr(_NOW))


def split_sets(spark, sf):
    split = SA.three_way_split(
        table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"])
    path = scratch(spark, "splits")
    K.write_splits(split, path)
    return spark.read.parquet(path).select("o_orderkey", "o_orderpriority", F.col("split").cast("string").alias("split"))


def stratified_split(spark, sf):
    return SA.stratified_split(
        table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])


# tables whose values both engines write alike, with their columns
_PRINTED = {"documents": "doc_id, text, lang, source, n_chars", "conversations": "conv_id, turn, role, text",
            "pages": "page_id, url, html", "labels": "doc_id, quality, toxic"}


def content_fingerprint(spark, sf):
    parts = [R.fingerprint(table(spark, sf, name)).select(F.lit(name).alias("name"), "*") for name in _PRINTED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ── schema ─────────────────────────────────────────────────────────────────────────────────────
_COLUMNS = {
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
}
_KIND = {"bigint": "numeric", "int": "numeric", "double": "numeric", "string": "text", "timestamp_ntz": "temporal"}


def _columns_sql(name: str) -> str:
    parts = [f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS dtype, '{_KIND[t]}' AS kind, "
             f"count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values FROM {name}"
             for i, (c, t) in enumerate(_COLUMNS[name])]
    return "cols AS (" + " UNION ALL ".join(parts) + f"""),
classified AS (SELECT *, CASE WHEN kind = 'numeric' AND distinct_values > 10 THEN 'NUMERIC' ELSE 'CATEGORICAL' END AS type,
  CASE WHEN kind = 'temporal' THEN '{I.REASON_TIMESTAMP}' WHEN non_null = 0 THEN '{I.REASON_EMPTY}'
    WHEN distinct_values = 1 THEN '{I.REASON_CONSTANT}'
    WHEN distinct_values >= 0.99 * non_null AND dtype <> 'double' THEN '{I.REASON_IDENTIFIER}'
    WHEN regexp_matches(column_name, '{S.ID_NAME_PATTERN}') THEN '{I.REASON_NAME}' END AS reason FROM cols)"""


def _schema_sql(name: str, target: str) -> str:
    return _columns_sql(name) + f""",
schema_tbl AS (SELECT position, column_name, dtype, type, column_name = '{target}' AS is_target,
  column_name <> '{target}' AND reason IS NULL AS is_feature,
  column_name <> '{target}' AND reason IS NOT NULL AS excluded,
  CASE WHEN column_name <> '{target}' THEN reason END AS exclusion_reason FROM classified)"""


def classify_columns(spark, sf):
    return I.classified_columns(table(spark, sf, "lineitem")).select(
        "column_name", "non_null", "distinct_values", "type")


def suggest_exclusions(spark, sf):
    return I.classified_columns(table(spark, sf, "events")).select("column_name", "exclusion_reason")


def infer_schema(spark, sf):
    return I.infer_schema(table(spark, sf, "orders"), "o_orderstatus")


def feature_columns(spark, sf):
    return infer_schema(spark, sf).filter("is_feature OR is_target").select(
        "position", "column_name", "is_target")


def _override_table(spark):
    return spark.createDataFrame(
        [("o_custkey", None, False, True), ("nowhere", "NUMERIC", True, False)],
        "column_name string, type string, is_feature boolean, excluded boolean")


def schema_overrides(spark, sf):
    return I.apply_overrides(infer_schema(spark, sf), _override_table(spark))


def dtype_kind(spark, sf):
    return I.dtype_kinds(table(spark, sf, "lineitem")).join(
        I.column_cardinalities(table(spark, sf, "lineitem")).select("column_name", "non_null"), "column_name")


#: what the files of each line number lack
_LACKING = {1: [], 2: ["l_tax"], 3: ["l_tax", "l_discount", "l_quantity"], 4: []}


def _arrived(spark, sf):
    """One folder of lineitem files for each line number, some without required columns."""
    folder = scratch(spark, "arrivals")
    lines = B.table(spark, sf, "lineitem").select("l_linenumber", *B.LINES_NUMERIC, *B.LINES_CATEGORICAL)
    for number, lacking in _LACKING.items():
        lines.where(F.col("l_linenumber") == number).drop(*lacking).write.parquet(f"{folder}/line={number}")
    required = spark.createDataFrame([(c,) for c in [*B.LINES_NUMERIC, *B.LINES_CATEGORICAL]], "feature string")
    return admit_files(spark, folder, required)


def wide_schema_check(spark, sf):
    verdicts = _arrived(spark, sf)[1]
    # files of one line number have the same columns
    return verdicts.select(F.regexp_extract("path", "line=([0-9]+)", 1).cast("long").alias("line"),
                           F.array_join("missing", ",").alias("missing"), "status", "message").distinct()


def accepted_files(spark, sf):
    rows = _arrived(spark, sf)[0]
    return rows.groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_tax"), 4).alias("tax"))


def batch_schema_check(spark, sf):
    feed = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS batch_id", "concat('f', CAST(l_linenumber AS STRING)) AS feature")
    required = feed.select("feature").distinct()
    return H.missing_required(feed, required, ["batch_id"])


def labels_flag(spark, sf):
    counts = outcome_counts(B.scored_documents(spark, sf), ["batch_id"], "y_true", "y_pred")
    return labels_available(counts, ["batch_id"])


def feature_selection(spark, sf):
    return I.require_columns(table(spark, sf, "lineitem"), ["l_discount", "l_quantity", "l_returnflag"])


def to_numeric(spark, sf):
    text = table(spark, sf, "events").select("event_id", F.when(
        F.col("event_type") == "view", F.lit("n/a")).when(F.col("event_type") == "click", F.lit("nan"))
        .otherwise(F.col("value").cast("string")).alias("raw"))
    return text.select("event_id", as_number("raw", T.StringType()).alias("number"))


# ── profiles ───────────────────────────────────────────────────────────────────────────────────
def _lines_long(spark, sf):
    return numeric_long(B.lines_baseline(spark, sf), B.LINES_NUMERIC, [])


def numeric_summary(spark, sf):
    out = P.numeric_summary(
        numeric_long(B.lines_batches(spark, sf), B.LINES_NUMERIC, ["batch_id"]), ["batch_id", "feature"])
    return rounded(out, "mean", "std", "min", "q1", "median", "q3", "max")


def categorical_summary(spark, sf):
    return P.categorical_summary(
        category_long(B.lines_batches(spark, sf), B.LINES_CATEGORICAL, ["batch_id"]), ["batch_id", "feature"])


def bin_edges(spark, sf):
    edges = P.bin_edges(_lines_long(spark, sf), ["feature"])
    return rounded(edges.select("feature", F.posexplode("bin_edges").alias("position", "edge")), "edge")


def bin_counts(spark, sf):
    edges = P.bin_edges(_lines_long(spark, sf), ["feature"])
    long = numeric_long(B.lines_batches(spark, sf), B.LINES_NUMERIC, ["batch_id"])
    counts = P.bin_counts(long, ["batch_id"], edges)
    return counts.select("batch_id", "feature", F.posexplode("bin_counts").alias("bin", "n"))


def build_profile(spark, sf):
    base = B.lines_baseline(spark, sf)
    num = P.profile_numeric(base, B.LINES_NUMERIC).select(
        "feature", F.lit("NUMERIC").alias("type"), "n", "missing", "mean", "std", "q1", "median", "q3",
        F.size("bin_counts").cast("long").alias("entries"))
    cat = P.profile_categorical(base, B.LINES_CATEGORICAL).select(
        "feature", F.lit("CATEGORICAL").alias("type"), "n", "missing",
        *[F.lit(None).cast("double").alias(c) for c in ("mean", "std", "q1", "median", "q3")],
        F.col("n_unique").alias("entries"))
    return rounded(num.unionByName(cat), "mean", "std", "q1", "median", "q3")


def _shares(spark, sf):
    return baseline_shares(B.category_profile(B.lines_baseline(spark, sf), B.LINES_CATEGORICAL))


def proportions(spark, sf):
    return rounded(_shares(spark, sf).select(
        "feature", "category", F.col("b").alias("n"), F.col("p").alias("share")), "share")


def smoothed(spark, sf):
    return rounded(_shares(spark, sf).select("feature", "category", (
        (F.col("p") + S.EPSILON) / (1.0 + F.col("k0") * S.EPSILON)).alias("smooth")), "smooth")


_LINES_PROFILE = [B.LINES_SQL, Q.numeric_rows("bl", "base", B.LINES_NUMERIC),
                  Q.numeric_rows("cl", "batch", B.LINES_NUMERIC, "batch_id, "), Q.PROFILE]
_LINES_CATS = [B.LINES_SQL, Q.category_rows("blc", "base", B.LINES_CATEGORICAL),
               Q.category_rows("clc", "batch", B.LINES_CATEGORICAL, "batch_id, "), Q.CATEGORY_COUNTS]
_R = "round({0}, 6) AS {1}"


def _split_sql(target: str, key: str, tail: str) -> str:
    return f"""WITH r AS (SELECT {key}, {target}, count(*) OVER (PARTITION BY {target}) AS n,
  row_number() OVER (PARTITION BY {target} ORDER BY md5(concat_ws('|', '42', CAST({key} AS VARCHAR)))) AS rn FROM orders)
SELECT {key}, {target}, {tail} AS split FROM r"""


QUERIES = {
    "wide_schema_check": wide_schema_check, "accepted_files": accepted_files,
    "read_table": read_table, "baseline_check": baseline_check, "reference_sample": reference_sample,
    "load_reference": load_reference, "ingest_batches": ingest_batches, "history_export": history_export,
    "clean_multi_file": clean_multi_file, "clean_coerce": clean_coerce, "blank_count": blank_count,
    "expired_batches": expired_batches, "split_sets": split_sets, "stratified_split": stratified_split,
    "content_fingerprint": content_fingerprint, "classify_columns": classify_columns,
    "suggest_exclusions": suggest_exclusions, "infer_schema": infer_schema,
    "feature_columns": feature_columns, "schema_overrides": schema_overrides, "dtype_kind": dtype_kind,
    "batch_schema_check": batch_schema_check, "labels_available": labels_flag,
    "feature_selection_for_scoring": feature_selection, "to_numeric_coerce": to_numeric,
    "numeric_summary": numeric_summary, "categorical_summary": categorical_summary,
    "bin_edges": bin_edges, "bin_counts": bin_counts, "build_profile": build_profile,
    "proportions": proportions, "smooth": smoothed,
}

ORACLES = {
    "wide_schema_check": """SELECT DISTINCT l_linenumber AS line, CASE l_linenumber WHEN 2 THEN 'l_tax'
  WHEN 3 THEN 'l_discount,l_quantity,l_tax' ELSE '' END AS missing, CASE WHEN l_linenumber IN (2, 3) THEN 'REJECTED' ELSE 'RECEIVED' END AS status,
  CASE l_linenumber WHEN 2 THEN 'Batch is missing 1 required column(s): l_tax'
  WHEN 3 THEN 'Batch is missing 3 required column(s): l_discount, l_quantity, l_tax' END AS message FROM lineitem WHERE l_linenumber <= 4""",
    "accepted_files": """SELECT l_linenumber, l_returnflag, count(*) AS n, round(sum(l_tax), 4) AS tax FROM lineitem
WHERE l_linenumber IN (1, 4) GROUP BY ALL""",
    "read_table": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
    "baseline_check": " UNION ALL ".join(_check_sql(n, t) for n, t in (
        ("events", "event_type"), ("orders", "o_orderstatus"), ("region", "r_name"), ("labels", "quality"))),
    "content_fingerprint": " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', "
        + ", ".join(f"coalesce(replace(replace(CAST({c} AS VARCHAR), '!', '!!'), '|', '!/'), '!-')" for c in columns.split(", "))
        + f")), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM {name}" for name, columns in _PRINTED.items()),
    "reference_sample": _SAMPLE_SQL,
    "load_reference": _SAMPLE_SQL,
    "ingest_batches": f"""WITH {B.EVENTS_SQL}, b AS (SELECT batch_id, count(*) AS row_count, true AS has_labels,
  max({_SOURCE}) AS source, max(ts) AS received_at FROM batch GROUP BY batch_id)
SELECT *, CASE source WHEN 'UPLOAD' THEN 'UPLOAD' WHEN 'SIMULATOR' THEN 'SCHEDULED' WHEN 'API' THEN 'API'
  ELSE 'MANUAL' END AS trigger_source FROM b""",
    "history_export": f"""WITH {B.RUNS_SQL}, {B.MODELS_SQL}
SELECT run_id AS "Run ID", name AS "Model", strftime(created_at, '%Y-%m-%d %H:%M:%S') AS "Timestamp",
  status AS "Run Status", drift_status AS "Drift Status", health_score AS "Health Score"
FROM runs JOIN models USING (model_id)""",
    "clean_multi_file": """SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment AS label
FROM customer WHERE c_acctbal >= 0""",
    "clean_coerce": """SELECT event_id, CASE WHEN event_type = 'view' THEN 0.0 ELSE value END AS charge,
  event_type = 'view' AS charge_blank FROM events""",
    "blank_count": "SELECT count(*) AS row_count, count(*) FILTER (event_type = 'view') AS blanks FROM events",
    "expired_batches": f"""SELECT * FROM (SELECT o_orderkey AS batch_id, o_orderdate AS received_at, {_FILE} AS file FROM orders)
WHERE received_at < {_NOW} - INTERVAL 30 DAYS AND file <> ''""",
    "split_sets": _split_sql("o_orderpriority", "o_orderkey", """CASE
  WHEN rn <= round_even(round_even(n * 0.4, 0) * 0.5, 0) THEN 'test'
  WHEN rn <= round_even(n * 0.4, 0) THEN 'holdout' ELSE 'baseline' END"""),
    "stratified_split": _split_sql("o_orderstatus", "o_orderkey",
                                   "CASE WHEN rn <= round_even(n * 0.25, 0) THEN 'test' ELSE 'train' END"),
    "classify_columns": f"WITH {_columns_sql('lineitem')} SELECT column_name, non_null, distinct_values, type FROM classified",
    "suggest_exclusions": f"WITH {_columns_sql('events')} SELECT column_name, reason AS exclusion_reason FROM classified",
    "infer_schema": f"WITH {_schema_sql('orders', 'o_orderstatus')} SELECT * FROM schema_tbl",
    "feature_columns": f"""WITH {_schema_sql('orders', 'o_orderstatus')}
SELECT position, column_name, is_target FROM schema_tbl WHERE is_feature OR is_target""",
    "schema_overrides": f"""WITH {_schema_sql('orders', 'o_orderstatus')}
SELECT position, column_name, dtype, type, is_target,
  CASE WHEN column_name = 'o_custkey' THEN false ELSE is_feature END AS is_feature,
  CASE WHEN column_name = 'o_custkey' THEN true ELSE excluded END AS excluded, exclusion_reason FROM schema_tbl""",
    "dtype_kind": f"WITH {_columns_sql('lineitem')} SELECT column_name, kind, non_null FROM cols",
    "batch_schema_check": """WITH feed AS (SELECT DISTINCT l_orderkey AS batch_id, concat('f', l_linenumber) AS feature FROM lineitem),
req AS (SELECT DISTINCT feature FROM feed),
gaps AS (SELECT batch_id, list(feature ORDER BY feature) AS m FROM (
  SELECT b.batch_id, r.feature FROM (SELECT DISTINCT batch_id FROM feed) b CROSS JOIN req r
  EXCEPT SELECT batch_id, feature FROM feed) GROUP BY batch_id)
SELECT batch_id, concat('Batch is missing ', len(m), ' required column(s): ', array_to_string(m[1:8], ', '),
  CASE WHEN len(m) > 8 THEN '…' ELSE '' END) AS message FROM gaps""",
    "labels_available": f"""WITH {B.SCORED_SQL}
SELECT batch_id, bool_or(y_true IS NOT NULL) AS labels_available FROM scored GROUP BY batch_id""",
    "feature_selection_for_scoring": "SELECT l_discount, l_quantity, l_returnflag FROM lineitem",
    "to_numeric_coerce": """SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click') THEN value END AS number FROM events""",
    "numeric_summary": Q.with_(B.LINES_SQL, Q.numeric_rows("cl", "batch", B.LINES_NUMERIC, "batch_id, ")) + f"""
SELECT batch_id, feature, count(v) AS n, count(*) - count(v) AS missing, {Q.pct('(count(*) - count(v))', 'count(*)')} AS missing_pct,
  round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q1,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS max
FROM cl GROUP BY batch_id, feature""",
    "categorical_summary": Q.with_(B.LINES_SQL, Q.category_rows("cl", "batch", B.LINES_CATEGORICAL, "batch_id, ")) + f"""
SELECT batch_id, feature, count(c) AS n, count(*) - count(c) AS missing, {Q.pct('(count(*) - count(c))', 'count(*)')} AS missing_pct,
  count(DISTINCT c) AS n_unique FROM cl GROUP BY batch_id, feature""",
    "bin_edges": Q.with_(*_LINES_PROFILE) + """
SELECT feature, i - 1 AS position, round(eds[i], 6) AS edge FROM (
  SELECT feature, eds, unnest(range(1, len(eds) + 1)) AS i FROM prof)""",
    "bin_counts": Q.with_(*_LINES_PROFILE, Q.BASE_BINS, Q.BATCH_BINS, Q.BIN_CELLS) + """
SELECT batch_id, feature, CAST(cell AS BIGINT) AS bin, c AS n FROM cells""",
    "build_profile": Q.with_(*_LINES_PROFILE, *_LINES_CATS[1:]) + """
SELECT feature, 'NUMERIC' AS type, n0 AS n, missing0 AS missing, round(mean0, 6) AS mean, round(std0, 6) AS std,
  round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3, len(eds) - 1 AS entries FROM prof
UNION ALL SELECT feature, 'CATEGORICAL', n0, 0, NULL, NULL, NULL, NULL, NULL, k0 FROM bs""",
    "proportions": Q.with_(*_LINES_CATS) + """
SELECT feature, cell AS category, n, round(n / n0, 6) AS share FROM b0 JOIN bs USING (feature)""",
    "smooth": Q.with_(*_LINES_CATS) + """
SELECT feature, cell AS category, round((n / n0 + 0.0001) / (1 + k0 * 0.0001), 6) AS smooth FROM b0 JOIN bs USING (feature)""",
}
