"""Per-feature drift of many batches against one baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import divergence as D
from ..functions.status import classify_feature, rollup, thresholds_of, with_limits
from ..storage import materialise, near
from .categories import CategoryBaseline, category_scores
from .ks import ks_of_counts
from .longform import category_long, numeric_long
from .profile import bin_array, bin_index
from .rank_index import RankIndex


def value_counts(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, value, present) -> n: what every numeric result of a batch is computed from.

    Map-side combine makes one row per task of a value that fills a batch.
    """
    return long.groupBy(*keys, "feature", "value", "present").agg(F.count("*").alias("n"))


def numeric_state(batches: DataFrame, profile: DataFrame, features: list[str],
                  keys: list[str], bins: int = S.BIN_COUNT) -> DataFrame:
    """One row per (batch, feature): everything drift, quality and summaries count."""
    return numeric_state_of(value_counts(numeric_long(batches, features, keys), keys), profile, keys, bins)


def profiled_on(profile: DataFrame, keys: list[str]) -> list[str]:
    """The columns a profile is joined on: the feature, with the model where the profile has several."""
    return [*[k for k in keys if k in profile.columns], "feature"]


def numeric_state_of(values: DataFrame, profile: DataFrame, keys: list[str], bins: int = S.BIN_COUNT) -> DataFrame:
    """``numeric_state`` of value counts. Its buffers are fixed-width, so it stays a hash aggregate."""
    on = profiled_on(profile, keys)
    spread = F.col("q3") - F.col("q1")
    base = near(profile.select(
        *on, "bin_edges", F.col("min").alias("base_min"), F.col("max").alias("base_max"),
        F.coalesce("mean", F.lit(0.0)).alias("_mid"),
        (F.col("q1") - S.OUTLIER_FENCE * spread).alias("lower_fence"),
        (F.col("q3") + S.OUTLIER_FENCE * spread).alias("upper_fence")))
    v, n = F.col("value"), F.when(F.col("value").isNotNull(), F.col("n"))

    def counted(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    # deviations are taken from the baseline's mean, so that squares stay small
    away = v - F.col("_mid")
    joined = values.join(base, on).withColumn("_bin", bin_index("value", "bin_edges", bins))
    state = joined.groupBy(*keys, "feature").agg(
        F.sum("n").alias("rows"), counted(F.col("present")).alias("n_present"), counted(v.isNotNull()).alias("n"),
        (F.sum(v * n) / F.sum(n)).alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(n * away * away) / F.sum(n) - F.pow(F.sum(n * away) / F.sum(n), F.lit(2.0))))
        .alias("_std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        counted(v < F.col("base_min")).alias("below_min"), counted(v > F.col("base_max")).alias("above_max"),
        counted((v < F.col("lower_fence")) | (v > F.col("upper_fence"))).alias("outliers"),
        *[counted(F.col("_bin") == i).alias(f"_bin{i}") for i in range(bins)])
    return state.join(near(profile.select(*on, "bin_edges")), on).select(
        *keys, "feature", "rows", (F.col("rows") - F.col("n_present")).alias("missing"),
        "n", (F.col("n_present") - F.col("n")).alias("unparsable"), "mean", F.when(F.col("n") > 0, F.col("_std")).alias("std"),
        "min", "max", "below_min", "above_max", "outliers", bin_array("bin_edges", bins).alias("bin_counts"))


def known_counts(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, value, c) of the values that are numbers, as KS wants them."""
    return values.filter(F.col("value").isNotNull()).select(*keys, "feature", "value", F.col("n").alias("c"))


def category_state(batches: DataFrame, features: list[str], keys: list[str],
                   declared: dict[str, str] | None = None) -> DataFrame:
    """(batch, feature, category) -> n. The null category counts missing values."""
    return category_long(batches, features, keys, declared).groupBy(
        *keys, "feature", "category").agg(F.count("*").alias("n"))


def category_sizes(state: DataFrame, keys: list[str]) -> DataFrame:
    """rows, n, missing, n_unique per (batch, feature)."""
    present = F.col("category").isNotNull()
    return state.groupBy(*keys, "feature").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(present).alias("n_unique"))


def numeric_drift(state: DataFrame, profile: DataFrame, ks: DataFrame, keys: list[str],
                  thresholds: dict | DataFrame | None = None) -> DataFrame:
    """PSI and JSD over baseline bins, KS, and the combined status.

    ``thresholds`` are overrides for all, or a table (model keys, thresholds).
    """
    on = profiled_on(profile, keys)
    base = near(profile.select(
        *on, F.col("bin_counts").alias("_base"), F.col("n").alias("n_baseline"),
        F.col("min").alias("_min"), F.col("max").alias("_max")))
    joined = state.join(base, on).join(
        ks.select(*keys, "feature", "ks", F.col("p_value").alias("_p")), [*keys, "feature"], "left")
    comparable = F.size("_base") == F.size("bin_counts")
    flat_apart = ((F.col("_min") == F.col("_max")) & (F.col("min") == F.col("max"))
                  & (F.col("_min") != F.col("min")))
    scored = joined.select(
        *keys, "feature", F.lit(S.NUMERIC).alias("feature_type"), F.lit(S.KS).alias("test_name"),
        F.coalesce("ks", F.lit(0.0)).alias("test_statistic"),
        F.when(flat_apart, F.lit(0.0)).otherwise(F.coalesce("_p", F.lit(1.0))).alias("p_value"),
        F.when(comparable, D.psi("_base", "bin_counts")).otherwise(0.0).alias("psi"),
        F.when(comparable, D.jsd("_base", "bin_counts")).otherwise(0.0).alias("jsd"),
        "n_baseline", F.col("n").alias("n_current"), F.lit(0).cast("long").alias("n_unseen"))
    return _with_status(scored, thresholds)


def categorical_drift(state: DataFrame, base: CategoryBaseline, keys: list[str],
                      thresholds: dict | DataFrame | None = None) -> DataFrame:
    """PSI and JSD over the union of categories, chi-square, and the combined status.

    ``state`` is read several times: pass a stored table, not a plan over the raw rows.
    """
    counts = state.filter(F.col("category").isNotNull())
    sizes = category_sizes(state, keys).select(*keys, "feature", F.col("n").alias("n_current"))
    base_sizes = base.totals.select(*base.keys, F.col("b0").alias("n_baseline"))
    scores = category_scores(counts, base, keys).drop("n_current")
    joined = sizes.join(base_sizes, base.keys).join(scores, [*keys, "feature"], "left")
    scored = joined.select(
        *keys, "feature", F.lit(S.CATEGORICAL).alias("feature_type"),
        F.lit(S.CHI2).alias("test_name"),
        F.coalesce("chi2", F.lit(0.0)).alias("test_statistic"),
        F.coalesce("p_value", F.lit(1.0)).alias("p_value"),
        F.coalesce("psi", F.lit(0.0)).alias("psi"), F.coalesce("jsd", F.lit(0.0)).alias("jsd"),
        "n_baseline", "n_current", F.coalesce("n_unseen", F.lit(0)).alias("n_unseen"))
    return _with_status(scored, thresholds)


def _with_status(scored: DataFrame, thresholds: dict | DataFrame | None) -> DataFrame:
    scored = with_limits(scored, thresholds)
    return scored.withColumn("status", classify_feature(
        F.col("psi"), F.col("jsd"), F.col("p_value"), F.col("n_baseline"), F.col("n_current"),
        thresholds_of(scored, thresholds)))


def absent_features(batch_keys: DataFrame, absent: list[tuple[str, str]], keys: list[str],
                    n_baseline: DataFrame | None = None) -> DataFrame:
    """Rows for profiled features the batch table lacks: not assessed, never scored.

    One output row per batch and absent feature, which is what the report shows.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(t).alias("feature_type"))
                      for f, t in absent])
    return absent_rows(batch_keys.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*"), keys)


def absent_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Result rows of (keys, feature, feature_type) that a batch has no values of."""
    null = F.lit(None).cast("double")
    out = rows.select(
        *keys, "feature", "feature_type",
        F.when(F.col("feature_type") == S.NUMERIC, S.KS).otherwise(S.CHI2).alias("test_name"),
        null.alias("test_statistic"), null.alias("p_value"), null.alias("psi"), null.alias("jsd"),
        F.lit(None).cast("long").alias("n_baseline"), F.lit(None).cast("long").alias("n_current"),
        F.lit(0).cast("long").alias("n_unseen"), F.lit(S.INSUFFICIENT).alias("status"))
    return out


def status_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    """Features per status and in total, per batch."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("features_total"),
        F.count_if(F.col("status") == S.HIGH).alias("features_high"),
        F.count_if(F.col("status") == S.MODERATE).alias("features_moderate"),
        F.count_if(F.col("status") == S.NONE).alias("features_none"),
        F.count_if(F.col("status") == S.INSUFFICIENT).alias("features_insufficient"))


def drift_rollup(results: DataFrame, keys: list[str], thresholds: dict | DataFrame | None = None) -> DataFrame:
    counts = with_limits(status_counts(results, keys), thresholds)
    evaluated = F.col("features_total") - F.col("features_insufficient")
    return counts.withColumn("drift_status", rollup(
        F.col("features_high"), F.col("features_moderate"), evaluated,
        thresholds_of(counts, thresholds)))


def severity_order(status: Column | None = None) -> Column:
    status = F.col("status") if status is None else status
    return (F.when(status == S.HIGH, 0).when(status == S.MODERATE, 1).when(status == S.NONE, 2)
            .otherwise(3))


def worst_first(results: DataFrame) -> DataFrame:
    """HIGH, MODERATE, NONE, INSUFFICIENT_DATA; then PSI, largest first."""
    return results.orderBy(
        severity_order(), F.desc(F.coalesce("psi", F.lit(0.0))), "feature")


def sorted_results(results: DataFrame, by: str = "status") -> DataFrame:
    """The result table in one of its display orders; unknown names mean by status."""
    zero = F.lit(0.0)
    orders = {
        "feature": [F.lower("feature")],
        "type": [F.col("feature_type")],
        "statistic": [F.desc(F.coalesce("test_statistic", zero))],
        "pvalue": [F.coalesce("p_value", F.lit(1.0))],
        "psi": [F.desc(F.coalesce("psi", zero))],
        "jsd": [F.desc(F.coalesce("jsd", zero))],
    }
    return results.orderBy(
        *orders.get(by, [severity_order(), F.desc(F.coalesce("psi", zero))]), "feature")


def drift_report(batches: DataFrame, profile_num: DataFrame | None, base: CategoryBaseline | None,
                 reference: RankIndex | None, numeric: list[str], categorical: list[str], keys: list[str],
                 thresholds: dict | None = None, declared: dict[str, str] | None = None) -> DataFrame:
    """All monitored features of all batches. Features the table lacks are reported as such.

    The raw rows are read twice, each time only the columns needed: for the value counts, which KS looks up in
    the rank index ``reference``, and for the category state.
    """
    here = set(batches.columns)
    parts = []
    num = [f for f in numeric if f in here]
    cat = [f for f in categorical if f in here]
    if num:
        values = materialise(value_counts(numeric_long(batches, num, keys), keys), "value-counts")
        state = numeric_state_of(values, profile_num, keys)
        ks = ks_of_counts(known_counts(values, keys), reference, keys)
        parts.append(numeric_drift(state, profile_num, ks, keys, thresholds))
    if cat:
        stored = materialise(category_state(batches, cat, keys, declared), "category-state")
        parts.append(categorical_drift(stored, base, keys, thresholds))
    gone = [(f, S.NUMERIC) for f in numeric if f not in here] + [
        (f, S.CATEGORICAL) for f in categorical if f not in here]
    if gone:
        parts.append(absent_features(batches.select(*keys).distinct(), gone, keys))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
