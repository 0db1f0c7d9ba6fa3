"""DuckDB text blocks the checks are assembled from. They align everything naively."""

from __future__ import annotations

EPS = "0.0001"


def with_(*blocks: str) -> str:
    return "WITH " + ",\n".join(blocks) + "\n"


def numeric_rows(name: str, source: str, features: list[str], key: str = "") -> str:
    parts = [f"SELECT {key}'{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM {source}" for f in features]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def category_rows(name: str, source: str, features: list[str], key: str = "") -> str:
    parts = [f"SELECT {key}'{f}' AS feature, CAST({f} AS VARCHAR) AS c FROM {source}" for f in features]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


_PROBS = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
EDGES = f"list_sort(list_distinct(quantile_cont(v, {_PROBS})))"


def bin_of(value: str = "v", edges: str = "eds") -> str:
    return f"len(list_filter({edges}[2:len({edges})-1], lambda e: {value} >= e))"


def pct(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN round_even(100.0 * {part} / {whole}, 4) ELSE 0.0 END)"


PROFILE = f"""prof AS (SELECT feature, count(v) AS n0, count(*) - count(v) AS missing0, count(*) AS rows0,
  avg(v) AS mean0, stddev_pop(v) AS std0, min(v) AS min0, max(v) AS max0,
  quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3,
  CASE WHEN len({EDGES}) = 1 THEN list_concat({EDGES}, {EDGES}) ELSE {EDGES} END AS eds
  FROM bl GROUP BY feature)"""

BASE_BINS = f"""bb AS (SELECT feature, bin, count(*) AS c FROM (
  SELECT feature, {bin_of()} AS bin FROM bl JOIN prof USING (feature) WHERE v IS NOT NULL)
  GROUP BY feature, bin)"""
BATCH_BINS = f"""cb AS (SELECT batch_id, feature, bin, count(*) AS c FROM (
  SELECT batch_id, feature, {bin_of()} AS bin FROM cl JOIN prof USING (feature) WHERE v IS NOT NULL)
  GROUP BY batch_id, feature, bin)"""
BIN_CELLS = """bt AS (SELECT batch_id, feature, count(v) AS n1, count(*) AS rows1 FROM cl GROUP BY batch_id, feature),
grid AS (SELECT batch_id, feature, unnest(range(len(eds) - 1)) AS bin, n0, n1 FROM bt JOIN prof USING (feature)),
cells AS (SELECT g.batch_id, g.feature, CAST(g.bin AS VARCHAR) AS cell, coalesce(bb.c, 0) AS b,
  coalesce(cb.c, 0) AS c, n0, n1
  FROM grid g LEFT JOIN bb ON bb.feature = g.feature AND bb.bin = g.bin
  LEFT JOIN cb ON cb.batch_id = g.batch_id AND cb.feature = g.feature AND cb.bin = g.bin)"""


def divergence(cells: str = "cells", out: str = "div") -> str:
    """psi and jsd per batch and feature over aligned cells (b of n0, c of n1)."""
    return f"""{out}_s AS (SELECT batch_id, feature,
  (coalesce(b / nullif(n0, 0), 0) + {EPS}) / (CASE WHEN n0 > 0 THEN 1 ELSE 0 END + {EPS} * count(*) OVER w) AS e,
  (coalesce(c / nullif(n1, 0), 0) + {EPS}) / (CASE WHEN n1 > 0 THEN 1 ELSE 0 END + {EPS} * count(*) OVER w) AS a
  FROM {cells} WINDOW w AS (PARTITION BY batch_id, feature)),
{out} AS (SELECT batch_id, feature, sum((a - e) * ln(a / e)) AS psi,
  greatest(0.0, least(1.0, sum(0.5 * (e * log2(e / ((a + e) / 2)) + a * log2(a / ((a + e) / 2)))))) AS jsd
  FROM {out}_s GROUP BY batch_id, feature)"""


CATEGORY_COUNTS = """b0 AS (SELECT feature, c AS cell, count(*) AS n FROM blc WHERE c IS NOT NULL GROUP BY feature, c),
c0 AS (SELECT batch_id, feature, c AS cell, count(*) AS n FROM clc WHERE c IS NOT NULL GROUP BY batch_id, feature, c),
bs AS (SELECT feature, sum(n) AS n0, count(*) AS k0 FROM b0 GROUP BY feature),
cs AS (SELECT batch_id, feature, count(c) AS n1, count(*) AS rows1, count(DISTINCT c) AS k1 FROM clc GROUP BY batch_id, feature)"""
CATEGORY_CELLS = """cat_union AS (SELECT batch_id, feature, cell FROM cs JOIN b0 USING (feature)
  UNION SELECT batch_id, feature, cell FROM c0),
catcells AS (SELECT u.batch_id, u.feature, u.cell, coalesce(b0.n, 0) AS b, coalesce(c0.n, 0) AS c, n0, n1
  FROM cat_union u JOIN cs USING (batch_id, feature) JOIN bs USING (feature)
  LEFT JOIN b0 ON b0.feature = u.feature AND b0.cell = u.cell
  LEFT JOIN c0 ON c0.batch_id = u.batch_id AND c0.feature = u.feature AND c0.cell = u.cell)"""


def chi2_p(stat: str, dof: str) -> str:
    """1 - P(dof/2, stat/2) by the series of Poisson-like terms."""
    return (f"(CASE WHEN {stat} <= 0 THEN 1.0 WHEN {stat} > {dof} + 400 + 60 * sqrt({dof}) THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - list_sum(list_transform(range(0, 1500), "
            f"lambda term: exp(({dof} / 2.0 + term) * ln({stat} / 2.0) - {stat} / 2.0 - lgamma({dof} / 2.0 + term + 1)))))) END)")


CHI_SQUARE = f"""chi_m AS (SELECT batch_id, feature, n0, n1,
  CASE WHEN least(n0, n1) * (b + c) / (n0 + n1) >= 5 THEN cell ELSE '__OTHER__' END AS merged, b, c FROM catcells),
chi_c AS (SELECT batch_id, feature, merged, any_value(n0) AS n0, any_value(n1) AS n1, sum(b) AS b, sum(c) AS c
  FROM chi_m GROUP BY batch_id, feature, merged),
chi_k AS (SELECT *, count(*) OVER (PARTITION BY batch_id, feature) AS k,
  n0 * (b + c) / (n0 + n1) AS eb, n1 * (b + c) / (n0 + n1) AS ec FROM chi_c),
chi_s AS (SELECT batch_id, feature, any_value(k) AS k,
  sum(pow(abs(b - eb) - CASE WHEN k = 2 THEN least(0.5, abs(b - eb)) ELSE 0 END, 2) / eb
    + pow(abs(c - ec) - CASE WHEN k = 2 THEN least(0.5, abs(c - ec)) ELSE 0 END, 2) / ec) AS s
  FROM chi_k GROUP BY batch_id, feature),
chi AS (SELECT batch_id, feature, k, CASE WHEN k < 2 THEN 0.0 ELSE s END AS chi2,
  CASE WHEN k < 2 THEN 1.0 ELSE {chi2_p('s', '(k - 1)')} END AS p FROM chi_s)"""

# pooled empirical distribution functions; the baseline is repeated per batch
KS = """pool AS (SELECT batch_id, feature, v, 0 AS side FROM bt JOIN rl USING (feature) WHERE v IS NOT NULL
  UNION ALL SELECT batch_id, feature, v, 1 AS side FROM cl WHERE v IS NOT NULL),
pv AS (SELECT batch_id, feature, v, sum(1 - side) AS x0, sum(side) AS x1 FROM pool GROUP BY batch_id, feature, v),
cum AS (SELECT batch_id, feature, sum(x0) OVER w AS f0, sum(x1) OVER w AS f1,
  sum(x0) OVER (PARTITION BY batch_id, feature) AS m0, sum(x1) OVER (PARTITION BY batch_id, feature) AS m1
  FROM pv WINDOW w AS (PARTITION BY batch_id, feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ksd AS (SELECT batch_id, feature, max(abs(f0 / m0 - f1 / m1)) AS d, any_value(m0) AS m0, any_value(m1) AS m1
  FROM cum WHERE m0 > 0 AND m1 > 0 GROUP BY batch_id, feature),
ksl AS (SELECT *, sqrt(CAST(m0 AS DOUBLE) * m1 / (m0 + m1)) AS en FROM ksd),
ks AS (SELECT batch_id, feature, d, m0, m1, CASE WHEN (en + 0.12 + 0.11 / en) * d < 0.2 THEN 1.0 ELSE
  greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda k:
    (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * pow((en + 0.12 + 0.11 / en) * d, 2)))))) END AS p
  FROM ksl)"""


def band(value: str, moderate: float, high: float) -> str:
    return f"(CASE WHEN {value} > {high} THEN 2 WHEN {value} >= {moderate} THEN 1 ELSE 0 END)"


#: moderate and high limit of PSI, then of JSD
LIMITS = (0.10, 0.25, 0.10, 0.20)


def status(psi: str, jsd: str, p: str, n0: str, n1: str, limits: tuple = LIMITS) -> str:
    mag = f"greatest({band(psi, *limits[:2])}, {band(jsd, *limits[2:])})"
    return (f"(CASE WHEN {n0} < 30 OR {n1} < 30 THEN 'INSUFFICIENT_DATA' "
            f"ELSE ['NONE', 'MODERATE', 'HIGH'][1 + CASE WHEN {mag} = 0 THEN 0 WHEN {p} < 0.05 THEN {mag} ELSE {mag} - 1 END] END)")


def numeric_drift(features: list[str], limits: tuple = LIMITS) -> list[str]:
    """Blocks ending in nd: one row per batch and numeric feature."""
    return [numeric_rows("bl", "base", features), numeric_rows("cl", "batch", features, "batch_id, "),
            numeric_rows("rl", "base", features), PROFILE, BASE_BINS, BATCH_BINS, BIN_CELLS, divergence(), KS,
            f"""nd AS (SELECT bt.batch_id, bt.feature, 'NUMERIC' AS feature_type, 'KS' AS test_name,
  coalesce(d, 0.0) AS stat, coalesce(p, 1.0) AS p, psi, jsd, n0, n1, 0 AS n_unseen,
  {status('psi', 'jsd', 'coalesce(p, 1.0)', 'n0', 'n1', limits)} AS status
  FROM bt JOIN prof USING (feature) JOIN div USING (batch_id, feature) LEFT JOIN ks USING (batch_id, feature))"""]


def categorical_drift(features: list[str], limits: tuple = LIMITS) -> list[str]:
    """Blocks ending in cd: one row per batch and categorical feature."""
    return [category_rows("blc", "base", features), category_rows("clc", "batch", features, "batch_id, "),
            CATEGORY_COUNTS, CATEGORY_CELLS, divergence("catcells", "cdiv"), CHI_SQUARE,
            """uns AS (SELECT batch_id, feature, count(*) AS n_unseen FROM c0 ANTI JOIN b0 USING (feature, cell)
  GROUP BY batch_id, feature)""",
            f"""cd AS (SELECT cs.batch_id, cs.feature, 'CATEGORICAL' AS feature_type, 'CHI2' AS test_name,
  coalesce(chi2, 0.0) AS stat, coalesce(p, 1.0) AS p, coalesce(psi, 0.0) AS psi, coalesce(jsd, 0.0) AS jsd,
  n0, n1, coalesce(n_unseen, 0) AS n_unseen,
  {status('coalesce(psi, 0.0)', 'coalesce(jsd, 0.0)', 'coalesce(p, 1.0)', 'n0', 'n1', limits)} AS status
  FROM cs JOIN bs USING (feature) LEFT JOIN cdiv USING (batch_id, feature)
  LEFT JOIN chi USING (batch_id, feature) LEFT JOIN uns USING (batch_id, feature))"""]


def drift(numeric: list[str], categorical: list[str], limits: tuple = LIMITS) -> list[str]:
    """Blocks ending in dr: every feature of every batch."""
    return [*numeric_drift(numeric, limits), *categorical_drift(categorical, limits),
            "dr AS (SELECT * FROM nd UNION ALL SELECT * FROM cd)"]


ROLLUP = """roll AS (SELECT batch_id, count(*) AS features_total, count(*) FILTER (status = 'HIGH') AS features_high,
  count(*) FILTER (status = 'MODERATE') AS features_moderate, count(*) FILTER (status = 'NONE') AS features_none,
  count(*) FILTER (status = 'INSUFFICIENT_DATA') AS features_insufficient FROM dr GROUP BY batch_id),
rolled AS (SELECT *, CASE WHEN features_total = features_insufficient THEN 'NONE'
  WHEN features_high >= 1 OR features_moderate / (features_total - features_insufficient) >= 0.3 THEN 'HIGH'
  WHEN features_moderate >= 1 THEN 'MODERATE' ELSE 'NONE' END AS drift_status FROM roll)"""


def quality(numeric: list[str], categorical: list[str], row_columns: str) -> list[str]:
    """Blocks qc (per column) and qr (per batch); needs the drift blocks."""
    f = "1.5 * (q3 - q1)"
    return [
        f"""qn AS (SELECT batch_id, feature, 'NUMERIC' AS type, count(*) AS rows, count(*) - count(v) AS missing,
  count(v) AS numeric_values, count(*) FILTER (v < min0) AS below_min, count(*) FILTER (v > max0) AS above_max,
  count(*) FILTER (v < q1 - {f} OR v > q3 + {f}) AS outliers, 0 AS unseen
  FROM cl JOIN prof USING (feature) GROUP BY batch_id, feature)""",
        """qk AS (SELECT cs.batch_id, cs.feature, 'CATEGORICAL' AS type, rows1 AS rows, rows1 - n1 AS missing,
  0 AS numeric_values, 0 AS below_min, 0 AS above_max, 0 AS outliers, coalesce(n_unseen, 0) AS unseen
  FROM cs LEFT JOIN uns USING (batch_id, feature))""",
        f"""qc AS (SELECT *, {pct('missing', 'rows')} AS missing_pct, below_min + above_max AS out_of_range,
  {pct('(below_min + above_max)', 'numeric_values')} AS out_of_range_pct, {pct('outliers', 'numeric_values')} AS outlier_pct
  FROM (SELECT * FROM qn UNION ALL SELECT * FROM qk))""",
        f"""dup AS (SELECT batch_id, sum(c) AS row_count, sum(c) - count(*) AS duplicate_rows FROM (
  SELECT batch_id, {row_columns}, count(*) AS c FROM batch GROUP BY batch_id, {row_columns}) GROUP BY batch_id)""",
        f"""qp AS (SELECT batch_id, count(*) AS columns_checked, sum(missing) AS missing_total, sum(rows) AS cells,
  sum(numeric_values) AS nums, sum(outliers) AS outlier_total, count(*) FILTER (unseen > 0) AS unseen_columns
  FROM qc GROUP BY batch_id)""",
        f"""qq AS (SELECT *, {pct('missing_total', 'cells')} AS missing_pct, {pct('duplicate_rows', 'row_count')} AS duplicate_pct,
  {pct('outlier_total', 'nums')} AS outlier_pct FROM dup JOIN qp USING (batch_id))""",
        """qw AS (SELECT *, least(30.0, missing_pct * 1.5) AS p1, least(20.0, duplicate_pct) AS p2,
  least(15.0, unseen_columns * 3.0) AS p4, least(15.0, outlier_pct * 0.5) AS p5 FROM qq)""",
        """qr AS (SELECT *, CAST(round_even(greatest(0.0, 100.0 - (p1 + p2 + p4 + p5)), 0) AS BIGINT) AS quality_score FROM qw)"""]
