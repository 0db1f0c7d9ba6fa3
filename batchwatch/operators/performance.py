"""Classifier metrics of every batch, from one (batch, truth, prediction) count table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome_counts(scored: DataFrame, keys: list[str], truth: str, prediction: str) -> DataFrame:
    """(batch, y_true, y_pred) -> n. As many rows as classes squared, whatever the batch size."""
    return scored.select(
        *keys, F.col(truth).cast("string").alias("y_true"),
        F.col(prediction).cast("string").alias("y_pred"),
    ).groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))


def labels_available(counts: DataFrame, keys: list[str]) -> DataFrame:
    """True for a batch with at least one non-null label."""
    return counts.groupBy(*keys).agg(F.max(F.col("y_true").isNotNull()).alias("labels_available"))


def _with_labels(per_class: DataFrame, batches: DataFrame, keys: list[str], labels: list | DataFrame,
                 name: str) -> DataFrame:
    """One row per batch and known class; the class list is the model's, so it is short.

    ``labels`` as a table has model keys and ``label``.
    """
    if isinstance(labels, DataFrame):
        grid = batches.select(*keys).join(labels.withColumnRenamed("label", name), [c for c in labels.columns if c in keys])
    else:
        grid = batches.select(
            *keys, F.explode(F.array(*[F.lit(str(x)) for x in labels])).alias(name))
    return grid.join(per_class, [*keys, name], "left").fillna(0)


def prediction_distribution(counts: DataFrame, keys: list[str], labels: list | DataFrame | None = None) -> DataFrame:
    """Per batch and class: count, share and total. Known classes never predicted show as 0."""
    per = counts.groupBy(*keys, "y_pred").agg(F.sum("n").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    if labels is not None:
        known = _with_labels(per, totals.select(*keys), keys, labels, "y_pred")
        if isinstance(labels, DataFrame):
            other = per.join(known.select(*keys, "y_pred"), [*keys, "y_pred"], "left_anti")
        else:
            other = per.filter(~F.col("y_pred").isin([str(x) for x in labels]))
        per = known.unionByName(other)
    return per.join(totals, keys).select(
        *keys, F.col("y_pred").alias("label"), "n",
        F.try_divide(F.col("n"), F.col("total")).alias("share"), "total")


def confusion_matrix(counts: DataFrame, keys: list[str], labels: list) -> DataFrame:
    """True x predicted counts over the class list, zeros included; other classes are left out."""
    names = F.array(*[F.lit(str(x)) for x in labels])
    labelled = counts.filter(F.col("y_true").isNotNull())
    grid = (labelled.select(*keys).distinct()
            .withColumn("y_true", F.explode(names)).withColumn("y_pred", F.explode(names)))
    return grid.join(labelled, [*keys, "y_true", "y_pred"], "left").fillna(0, ["n"])


def class_totals(counts: DataFrame, keys: list[str], labels: list | DataFrame | None = None) -> DataFrame:
    """Per batch and class: support, predicted and true-positive counts over labelled rows."""
    labelled = counts.filter(F.col("y_true").isNotNull())
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"),
                 zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("y_pred").alias("label"), zero.alias("support"),
                 F.col("n").alias("predicted"), zero.alias("tp")))
    per = (labelled.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
           .groupBy(*keys, "label").agg(
               F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
               F.sum("tp").alias("tp")))
    if labels is None:
        return per.filter(F.col("label").isNotNull())
    return _with_labels(per, labelled.select(*keys).distinct(), keys, labels, "label")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_metrics(totals: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class; an undefined ratio is 0."""
    return totals.withColumn("precision", _ratio(F.col("tp"), F.col("predicted"))).withColumn(
        "recall", _ratio(F.col("tp"), F.col("support"))).withColumn(
        "f1", _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")))


def accuracy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """accuracy, error_rate and sample_count over labelled rows."""
    labelled = counts.filter(F.col("y_true").isNotNull())
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    return labelled.groupBy(*keys).agg(
        (F.sum(hit) / F.sum("n")).alias("accuracy"), F.sum("n").alias("sample_count"),
    ).withColumn("error_rate", 1.0 - F.col("accuracy"))


def macro_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"))


def positive_metrics(metrics: DataFrame, keys: list[str], positive: str | DataFrame | None) -> DataFrame:
    """Metrics of the positive class; null unless there are exactly two classes incl. it.

    ``positive`` as a table has model keys and ``positive``.
    """
    if isinstance(positive, DataFrame):
        metrics = metrics.join(positive, [c for c in positive.columns if c in keys], "left")
        own = F.col("positive")
    else:
        own = F.lit(positive).cast("string")
    is_positive = F.col("label") == own
    binary = (F.count("*") == 2) & (F.count_if(is_positive) == 1)
    return metrics.groupBy(*keys).agg(*[
        F.when(binary, F.max(F.when(is_positive, F.col(m)))).alias(f"{m}_positive")
        for m in ("precision", "recall", "f1")],
        F.when(binary, F.max(own)).alias("positive_class"))


def performance_block(counts: DataFrame, keys: list[str], labels: list | DataFrame | None = None,
                      positive: str | DataFrame | None = None) -> DataFrame:
    """Everything known about a batch; metrics of unlabelled batches are null, never 0."""
    per_class = class_metrics(class_totals(counts, keys, labels))
    sizes = counts.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.max(F.col("y_true").isNotNull()).alias("labels_available"))
    return (sizes.join(accuracy(counts, keys), keys, "left")
            .join(macro_metrics(per_class, keys), keys, "left")
            .join(positive_metrics(per_class, keys, positive), keys, "left")
            .withColumn("sample_count", F.coalesce("sample_count", "rows")))


def prediction_gate(scored_counts: DataFrame, classes: DataFrame, rows_in: int) -> DataFrame:
    """Admission of a model: one prediction per row, and only classes the target has.

    ``scored_counts`` has y_pred and n, ``classes`` the column y_pred.
    """
    known = classes.select("y_pred").distinct().withColumn("_known", F.lit(True))
    return scored_counts.join(known, "y_pred", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("predictions"),
        F.count_if(F.col("_known").isNull()).alias("foreign_classes"),
    ).select(
        F.lit(rows_in).cast("long").alias("rows"), "predictions", "foreign_classes",
        ((F.col("predictions") == rows_in) & (F.col("foreign_classes") == 0)).alias("passed"))
