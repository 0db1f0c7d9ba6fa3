"""Drift status and health scalars as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .values import half_even

Thresholds = Mapping[str, Column]


def literal_thresholds(overrides: dict | None = None) -> dict[str, Column]:
    return {k: F.lit(float(v)) for k, v in {**S.THRESHOLDS, **(overrides or {})}.items()}


def column_thresholds(prefix: str) -> dict[str, Column]:
    """Thresholds read from a struct column, e.g. the snapshot on a run."""
    return {k: F.col(f"{prefix}.{k}") for k in S.THRESHOLDS}


def thresholds_of(rows: DataFrame, overrides: dict | DataFrame | None = None) -> dict[str, Column]:
    """The limits rows are judged by: those of their own struct column ``thresholds``, else the same for all."""
    if "thresholds" in rows.columns:
        return column_thresholds("thresholds")
    return literal_thresholds(overrides)


def with_limits(rows: DataFrame, limits: dict | DataFrame | None) -> DataFrame:
    """Rows with the limits of their model where ``limits`` is a table (model keys, thresholds)."""
    if not isinstance(limits, DataFrame) or "thresholds" in rows.columns:
        return rows
    return rows.join(limits, [c for c in limits.columns if c != "thresholds"])


def severity_rank(status: Column) -> Column:
    return F.when(status == S.HIGH, 2).when(status == S.MODERATE, 1).when(status == S.NONE, 0)


def from_rank(rank: Column) -> Column:
    return F.when(rank >= 2, S.HIGH).when(rank == 1, S.MODERATE).otherwise(S.NONE)


def band(value: Column, moderate: Column, high: Column) -> Column:
    """Above high: HIGH; at or above moderate: MODERATE; else NONE."""
    return F.when(value > high, S.HIGH).when(value >= moderate, S.MODERATE).otherwise(S.NONE)


def worst_status(*statuses: Column) -> Column:
    return from_rank(F.greatest(*[severity_rank(s) for s in statuses]))


def downgrade(status: Column) -> Column:
    return from_rank(F.greatest(severity_rank(status) - 1, F.lit(0)))


def classify_feature(psi: Column, jsd: Column, p_value: Column, n_baseline: Column,
                     n_current: Column, t: Thresholds) -> Column:
    """Magnitude proposes a status, significance confirms it or takes one level off."""
    minimum = F.floor(t["min_samples"])
    magnitude = worst_status(
        band(psi, t["psi_moderate"], t["psi_high"]), band(jsd, t["jsd_moderate"], t["jsd_high"]))
    return (F.when((n_baseline < minimum) | (n_current < minimum), S.INSUFFICIENT)
            .when(magnitude == S.NONE, S.NONE)
            .when(p_value < t["alpha"], magnitude)
            .otherwise(downgrade(magnitude)))


def rollup(high: Column, moderate: Column, evaluated: Column, t: Thresholds) -> Column:
    """Run status from feature counts; features without enough data are not evaluated."""
    ratio = F.try_divide(moderate, evaluated)
    return (F.when(evaluated == 0, S.NONE)
            .when((high >= 1) | (ratio >= t["moderate_ratio_for_high"]), S.HIGH)
            .when(moderate >= 1, S.MODERATE)
            .otherwise(S.NONE))


def clamp(value: Column) -> Column:
    """Limit to 0..100; unknown stays unknown (greatest and least alone would skip the null)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value.cast("double"))))


def accuracy_drop(accuracy: Column, reference: Column) -> Column:
    return reference - accuracy


def performance_component(accuracy: Column, reference: Column) -> Column:
    drop = F.greatest(F.lit(0.0), accuracy_drop(accuracy, reference))
    return (F.when(accuracy.isNull(), F.lit(None).cast("double"))
            .when(reference.isNull(), F.lit(100.0))
            .otherwise(clamp(100.0 - 200.0 * drop)))


def drift_component(high: Column, moderate: Column) -> Column:
    return clamp(100.0 - 15.0 * high - 6.0 * moderate)


def stability_component(divergence: Column) -> Column:
    """From the divergence of the two class mixes; null (either mix unknown) counts as stable."""
    return F.when(divergence.isNull(), F.lit(100.0)).otherwise(clamp(100.0 - 200.0 * divergence))


def health_weights(labelled: Column) -> Column:
    names = ("performance", "drift", "quality", "stability")
    return F.when(labelled, F.struct(*[F.lit(w).alias(n) for n, w in zip(names, S.WEIGHTS_LABELLED)])
                  ).otherwise(F.struct(*[F.lit(w).alias(n) for n, w in zip(names, S.WEIGHTS_UNLABELLED)]))


def health_band(score: Column) -> Column:
    return (F.when(score >= S.HEALTHY_MIN, S.HEALTHY).when(score >= S.WARNING_MIN, S.WARNING)
            .otherwise(S.CRITICAL))


def coherence_cap(score: Column, drift_status: Column) -> Column:
    """A run with HIGH drift never scores as healthy."""
    return F.when(drift_status == S.HIGH, F.least(score, F.lit(S.DRIFT_CEILING))).otherwise(score)


def weighted_health(performance: Column, drift: Column, quality: Column, stability: Column,
                    labelled: Column) -> Column:
    """Weighted mean of the components, half-even, before the cap."""
    w = health_weights(labelled & performance.isNotNull())
    parts = {"performance": F.coalesce(performance, F.lit(0.0)), "drift": drift,
             "quality": quality, "stability": stability}
    total = sum((w[n] for n in parts), F.lit(0.0))
    return half_even(sum((c * w[n] for n, c in parts.items()), F.lit(0.0)) / total)
