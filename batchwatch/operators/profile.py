"""The baseline's statistical fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import pct
from ..schemas import BIN_COUNT
from ..storage import local_copy, near
from .longform import category_long
from .quantiles import exact_quantiles
from .rank_index import RankIndex, moments_of, quantiles_of, rank_index

_QUARTILES = [0.25, 0.5, 0.75]


def _edge_probs(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def edges_from_quantiles(quantiles: Column) -> Column:
    """Sorted distinct quantiles; a constant column gives [v, v]."""
    distinct = F.array_sort(F.array_distinct(quantiles))
    return F.when(F.size(distinct) == 1, F.concat(distinct, distinct)).otherwise(distinct)


def bin_edges(long: DataFrame, keys: list[str], bins: int = BIN_COUNT) -> DataFrame:
    q = exact_quantiles(long, keys, _edge_probs(bins))
    return q.select(*keys, edges_from_quantiles(F.col("quantiles")).alias("bin_edges"))


def bin_index(value: str, edges: str, bins: int = BIN_COUNT) -> Column:
    """Bin of a value: how many inner edges it reaches. Outer edges count as infinite.

    Written as a sum of comparisons on array elements, which stays in generated code.
    """
    steps = [f"(CASE WHEN size({edges}) > {i + 1} AND {value} >= get({edges}, {i}) THEN 1 ELSE 0 END)"
             for i in range(1, bins)]
    return F.expr(f"CASE WHEN {value} IS NOT NULL AND {edges} IS NOT NULL THEN {' + '.join(steps)} END")


def bin_count_columns(bin_column: str = "_bin", bins: int = BIN_COUNT) -> list[Column]:
    """One fixed-width counter per bin."""
    return [F.expr(f"count_if({bin_column} = {i})").alias(f"_bin{i}") for i in range(bins)]


def bin_array(edges: str, bins: int = BIN_COUNT) -> Column:
    """The per-bin counts as an array as long as the edges allow (no edges: one empty bin)."""
    counters = ", ".join(f"_bin{i}" for i in range(bins))
    return F.expr(f"slice(array({counters}), 1, greatest(coalesce(size({edges}), 0) - 1, 1))")


def bin_counts(long: DataFrame, keys: list[str], edges: DataFrame,
               bins: int = BIN_COUNT) -> DataFrame:
    """keys + feature + bin_counts of the rows over the given edges (one row per feature)."""
    joined = long.join(F.broadcast(edges.select("feature", "bin_edges")), "feature").withColumn(
        "_bin", bin_index("value", "bin_edges", bins))
    counted = joined.groupBy(*keys, "feature").agg(
        *bin_count_columns("_bin", bins))
    # the edges come back by a second small join: an array in the aggregation buffer would
    # turn the hash aggregate into a sort
    counted = counted.join(F.broadcast(edges.select("feature", "bin_edges")), "feature")
    return counted.select(*keys, "feature", bin_array("bin_edges", bins).alias("bin_counts"))


def numeric_summary(long: DataFrame, keys: list[str]) -> DataFrame:
    """count, missing, moments, range and quartiles per group; all-null groups give nulls."""
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.count("*").alias("_rows"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, keys, _QUARTILES)
    return moments.join(q, keys, "left").select(
        *keys, "n", "missing", pct(F.col("missing"), F.col("_rows")).alias("missing_pct"),
        "mean", "std", "min",
        F.get("quantiles", F.lit(0)).alias("q1"), F.get("quantiles", F.lit(1)).alias("median"),
        F.get("quantiles", F.lit(2)).alias("q3"), "max")


def category_counts(long: DataFrame, keys: list[str]) -> DataFrame:
    """keys + category + n over non-null categories."""
    return long.filter(F.col("category").isNotNull()).groupBy(*keys, "category").agg(
        F.count("*").alias("n"))


def categorical_summary(long: DataFrame, keys: list[str]) -> DataFrame:
    """count, missing, missing_pct, n_unique per group, from per-category partial counts."""
    return counted_summary(long.groupBy(*keys, "category").agg(F.count("*").alias("n")), keys)


def counted_summary(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``categorical_summary`` of counts (keys, category, n), the null category's included."""
    present = F.col("category").isNotNull()
    return counts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(present).alias("n_unique"),
        F.sum("n").alias("_rows"),
    ).select(*keys, "n", "missing", pct(F.col("missing"), F.col("_rows")).alias("missing_pct"),
             "n_unique")


def profile_numeric(df: DataFrame, features: list[str], bins: int = BIN_COUNT, index: RankIndex | None = None) -> DataFrame:
    """One row per numeric feature: summary, bin edges, bin counts. ``index`` is the features' index, if there already."""
    return profile_index(rank_index(df, features) if index is None else index, bins)


def profile_index(index: RankIndex, bins: int = BIN_COUNT) -> DataFrame:
    """The numeric profile, from value counts and quantiles of the index; the rows are not read again."""
    group = index.group
    q = near(local_copy(quantiles_of(index, _edge_probs(bins) + _QUARTILES).select(
        *group, "quantiles", edges_from_quantiles(F.slice("quantiles", 1, bins + 1)).alias("bin_edges"))))
    binned = index.counts.join(q, group, "left").withColumn(
        "_bin", bin_index("value", "bin_edges", bins))
    counters = [F.expr(f"coalesce(sum(CASE WHEN _bin = {i} THEN n END), 0L)").alias(f"_bin{i}") for i in range(bins)]
    stats = moments_of(index, counters, binned).join(q, group, "left")
    empty = F.array().cast("array<double>")
    return stats.select(
        *group, "n", "missing", pct(F.col("missing"), F.col("n") + F.col("missing")).alias("missing_pct"),
        "mean", "std", "min", F.get("quantiles", F.lit(bins + 1)).alias("q1"),
        F.get("quantiles", F.lit(bins + 2)).alias("median"),
        F.get("quantiles", F.lit(bins + 3)).alias("q3"), "max",
        F.coalesce("bin_edges", empty).alias("bin_edges"),
        F.when(F.col("bin_edges").isNull(), F.array(F.lit(0).cast("long")))
        .otherwise(bin_array("bin_edges", bins)).alias("bin_counts"))


def profile_categories(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, category, n: the baseline's category frequencies."""
    return category_counts(category_long(df, features, []), ["feature"])


def profile_categorical(df: DataFrame, features: list[str]) -> DataFrame:
    return categorical_summary(category_long(df, features, []), ["feature"])


def stored_profile(profile: DataFrame) -> DataFrame:
    """The numeric profile, one row per feature column, kept so that no job recomputes it."""
    return local_copy(profile)
