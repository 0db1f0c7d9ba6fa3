"""Drift and fault injection on the events batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import perturb as P
from . import bindings as B
from . import sql as Q
from .bindings import rounded

KEY, ROW = ["batch_id"], ["event_id"]
_MIX = {"click": 0.6, "view": 0.3, "absent": 0.1}


def _summary(spark, sf) -> dict:
    row = B.numeric_profile(B.events_baseline(spark, sf), ["value"]).first()
    return {"value": {c: row[c] for c in ("std", "q1", "q3", "max")}}


def _values(df):
    return rounded(df.select("batch_id", "event_id", "value"), "value")


def numeric_shift(spark, sf):
    std = _summary(spark, sf)["value"]["std"]
    return _values(P.numeric_shift(B.events_batches(spark, sf), "value", 2.0, std, KEY, ROW, 0.22))


def numeric_scale(spark, sf):
    scaled = P.numeric_scale(B.events_batches(spark, sf), "value", 1.4, KEY)
    return rounded(scaled.select("batch_id", "event_id", "value"), "value", places=9)


def missing_injection(spark, sf):
    return _values(P.missing_injection(B.events_batches(spark, sf), "value", 0.03, KEY, ROW))


def outlier_injection(spark, sf):
    return _values(P.outlier_injection(
        B.events_batches(spark, sf), "value", 0.04, _summary(spark, sf)["value"], KEY, ROW))


def duplicate_injection(spark, sf):
    return P.duplicate_injection(B.events_batches(spark, sf), 0.05, KEY, ROW).select("batch_id", "event_id")


def category_shift(spark, sf):
    return P.category_shift(B.events_batches(spark, sf), "event_type", _MIX, KEY, ROW).select(
        "batch_id", "event_id", "event_type")


QUERIES = {f.__name__: f for f in (
    numeric_shift, numeric_scale, missing_injection, outlier_injection, duplicate_injection,
    category_shift)}

_RANKED = f"""{B.EVENTS_SQL}, s AS (SELECT stddev_pop(value) AS std, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM base),
r AS (SELECT batch_id, event_id, value, event_type, count(*) OVER (PARTITION BY batch_id) AS n,
  row_number() OVER (PARTITION BY batch_id ORDER BY md5(concat_ws('|', '42', CAST(event_id AS VARCHAR)))) AS rn FROM batch)"""


def _edit(rate: float, changed: str, plain: str = "value") -> str:
    return Q.with_(_RANKED) + f"""SELECT batch_id, event_id, round(CASE WHEN rn <= round_even(n * {rate}::DOUBLE, 0) THEN {changed} ELSE {plain} END, 6) AS value
FROM r CROSS JOIN s"""


ORACLES = {
    "numeric_shift": _edit(0.22, "value + 2.0 * std"),
    "missing_injection": _edit(0.03, "NULL"),
    "outlier_injection": _edit(0.04, "q3 + 5 * (q3 - q1)"),
    "numeric_scale": Q.with_(B.EVENTS_SQL) + """SELECT batch_id, event_id, round(m + (value - m) * 1.4, 9) AS value
FROM (SELECT *, avg(value) OVER (PARTITION BY batch_id) AS m FROM batch)""",
    "duplicate_injection": Q.with_(_RANKED) + """SELECT batch_id, event_id FROM r
UNION ALL SELECT batch_id, event_id FROM r WHERE rn <= round_even(n * 0.05::DOUBLE, 0)""",
    "category_shift": Q.with_(B.EVENTS_SQL) + """, t AS (SELECT batch_id, count(*) AS total FROM batch GROUP BY batch_id),
p AS (SELECT batch_id, event_type, count(*) AS avail, any_value(total) AS total, CASE event_type WHEN 'click' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS share
  FROM batch JOIN t USING (batch_id) WHERE event_type IN ('click', 'view') GROUP BY batch_id, event_type),
w AS (SELECT *, CAST(round_even(total * share / sum(share) OVER g, 0) AS BIGINT) AS wanted FROM p WINDOW g AS (PARTITION BY batch_id)),
x AS (SELECT *, wanted + CASE WHEN row_number() OVER (PARTITION BY batch_id ORDER BY share DESC, event_type DESC) = 1
  THEN total - sum(wanted) OVER (PARTITION BY batch_id) ELSE 0 END AS k FROM w),
r AS (SELECT b.batch_id, b.event_id, b.event_type, k, avail,
  row_number() OVER (PARTITION BY b.batch_id, b.event_type ORDER BY md5(concat_ws('|', '42', CAST(event_id AS VARCHAR)))) AS rn
  FROM batch b JOIN x USING (batch_id, event_type)),
c AS (SELECT *, unnest(range(1, CAST(k // avail + CASE WHEN rn <= k % avail THEN 1 ELSE 0 END + 1 AS BIGINT))) AS copy FROM r)
SELECT batch_id, CASE WHEN copy = 1 THEN CAST(event_id AS VARCHAR) ELSE concat(event_id, '#', copy) END AS event_id, event_type FROM c""",
}
