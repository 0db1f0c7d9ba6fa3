"""Health score of every run with its breakdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status as St
from ..storage import local_copy
from .categories import category_baseline, category_divergence


def mix_divergence(counts: DataFrame, baseline_mix: DataFrame, keys: list[str]) -> DataFrame:
    """JSD of every batch's predicted class mix to the model's mix on its baseline.

    ``counts`` has keys, y_pred, n; ``baseline_mix`` y_pred, n, one row per class, with model keys if of several.
    """
    own = [k for k in keys if k in baseline_mix.columns]

    def as_categories(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("y_pred", "category").withColumn("feature", F.lit("mix"))

    batch = as_categories(counts.groupBy(*keys, "y_pred").agg(F.sum("n").alias("n")))
    if own:  # the mix of other models is not known
        batch = batch.join(baseline_mix.select(*own).distinct(), own, "left_semi")
    base = category_baseline(local_copy(as_categories(baseline_mix.select(*own, "y_pred", "n"))), [*own, "feature"])
    return category_divergence(batch, base, keys).select(*keys, F.col("jsd").alias("mix_jsd"))


def health_score(runs: DataFrame) -> DataFrame:
    """Adds components, weights, raw and capped score, band.

    Needs accuracy, reference_accuracy, features_high, features_moderate, quality_score, mix_jsd,
    labels_available, drift_status.
    """
    performance = St.performance_component(F.col("accuracy"), F.col("reference_accuracy"))
    labelled = F.col("labels_available") & performance.isNotNull()
    parts = (runs.withColumn("health_performance", performance)
             .withColumn("health_drift", St.drift_component(
                 F.col("features_high"), F.col("features_moderate")))
             .withColumn("health_quality", St.clamp(F.col("quality_score")))
             .withColumn("health_stability", St.stability_component(F.col("mix_jsd")))
             .withColumn("weighting", F.when(labelled, "with_labels").otherwise("without_labels"))
             .withColumn("weights", St.health_weights(labelled)))
    raw = St.weighted_health(
        F.col("health_performance"), F.col("health_drift"), F.col("health_quality"),
        F.col("health_stability"), labelled)
    scored = parts.withColumn("health_raw_score", raw).withColumn(
        "health_score", St.coherence_cap(F.col("health_raw_score"), F.col("drift_status")))
    return scored.withColumn(
        "health_capped", F.col("health_score") != F.col("health_raw_score")).withColumn(
        "health_band", St.health_band(F.col("health_score")))


def health_breakdown(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run and component, in display order."""
    names = ("performance", "drift", "quality", "stability")
    rows = F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(n.title()).alias("component"),
        F.bround(F.col(f"health_{n}"), 2).alias("score"), F.col(f"weights.{n}").alias("weight"))
        for i, n in enumerate(names)])
    return scored.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
