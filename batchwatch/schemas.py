"""Shared constants, threshold sets and explicit table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The literals below are part of the result contract.
NUMERIC, CATEGORICAL = "NUMERIC", "CATEGORICAL"
NONE, MODERATE, HIGH, INSUFFICIENT = "NONE", "MODERATE", "HIGH", "INSUFFICIENT_DATA"
KS, CHI2 = "KS", "CHI2"
HEALTHY, WARNING, CRITICAL, INFO = "HEALTHY", "WARNING", "CRITICAL", "INFO"
COMPLETED, FAILED, REJECTED = "COMPLETED", "FAILED", "REJECTED"

SEED = 42
BIN_COUNT = 10
MAX_DISTINCT_CATEGORICAL = 10
REFERENCE_CAP = 50_000
MIN_BASELINE_ROWS = 100
EPSILON = 1e-4
MIN_EXPECTED_CELL = 5
OUTLIER_FENCE = 1.5
INJECTED_OUTLIER_FENCE = 5.0
CONSECUTIVE_RUNS = 2
DRIFTED_FEATURES_FOR_RETRAIN = 3
CLEAN_RUNS_TO_RESOLVE = 3
POOR_QUALITY, DEGRADED_QUALITY = 50, 70
HEALTHY_MIN, WARNING_MIN, DRIFT_CEILING = 80, 60, 79
RETENTION_DAYS = 30
MAX_POINTS = 500
PAGE_SIZE = 25

ID_NAME_PATTERN = (
    r"(?i)(^id$|_id$|^id_|id$|uuid|guid|^key$|_key$|^index$|serial|^no$|number$)"
)

DRIFT_THRESHOLDS = {
    "psi_moderate": 0.10,
    "psi_high": 0.25,
    "jsd_moderate": 0.10,
    "jsd_high": 0.20,
    "alpha": 0.05,
    "moderate_ratio_for_high": 0.30,
    "min_samples": 30.0,
}
THRESHOLDS = {
    **DRIFT_THRESHOLDS,
    "missing_value_rate_threshold": 0.05,
    "duplicate_row_rate_threshold": 0.01,
    "outlier_rate_threshold": 0.05,
    "accuracy_drop_minor": 0.05,
    "accuracy_drop_major": 0.10,
    "health_warning_threshold": 80.0,
    "health_critical_threshold": 60.0,
    "alert_cooldown_minutes": 60.0,
}
QUALITY_WEIGHTS = {
    "missing_rate": 1.5,
    "missing_cap": 30.0,
    "duplicate_rate": 1.0,
    "duplicate_cap": 20.0,
    "type_mismatch_per_column": 10.0,
    "type_mismatch_cap": 20.0,
    "unseen_category_per_column": 3.0,
    "unseen_category_cap": 15.0,
    "outlier_rate": 0.5,
    "outlier_cap": 15.0,
}
# component weights: (performance, drift, quality, stability)
WEIGHTS_LABELLED = (40.0, 30.0, 20.0, 10.0)
WEIGHTS_UNLABELLED = (0.0, 50.0, 35.0, 15.0)

_s, _l, _d, _b, _t = (
    T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCHEMA_TABLE = _struct(
    position=_l, column_name=_s, dtype=_s, type=_s, is_target=_b, is_feature=_b,
    excluded=_b, exclusion_reason=_s,
)
PROFILE_NUMERIC = _struct(
    feature=_s, n=_l, missing=_l, missing_pct=_d, mean=_d, std=_d, min=_d, q1=_d,
    median=_d, q3=_d, max=_d, bin_edges=T.ArrayType(_d), bin_counts=T.ArrayType(_l),
)
PROFILE_CATEGORIES = _struct(feature=_s, category=_s, n=_l)
PROFILE_CATEGORICAL = _struct(feature=_s, n=_l, missing=_l, missing_pct=_d, n_unique=_l)
THRESHOLD_TABLE = T.StructType(
    [T.StructField("model_id", _s)] + [T.StructField(k, _d) for k in THRESHOLDS]
)
OCCURRENCES = _struct(
    model_id=_s, category=_s, feature=_s, seen_at=_t, severity=_s, rule_code=_s,
    headline=_s, message=_s, run_id=_s,
)
