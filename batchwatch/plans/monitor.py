"""The whole monitoring run: quality, drift, performance, health and explanations per batch."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.status import with_limits
from ..functions.values import dtype_kind, pct
from ..operators import categories as C
from ..operators import drift as D
from ..operators import explain as E
from ..operators import health as H
from ..operators import performance as P
from ..operators import quality as Q
from ..operators.ks import ks_of_counts
from ..operators.longform import numeric_long
from ..operators.profile import counted_summary, profile_index, stored_profile
from ..operators.quantiles import counted_quantiles
from ..operators.rank_index import RankIndex, rank_index
from ..storage import local_copy, materialise, near


@dataclass
class Baseline:
    """A profiled baseline. The tables are small next to the data they describe."""

    numeric: list[str]
    categorical: list[str]
    profile: DataFrame | None
    categories: C.CategoryBaseline | None
    index: RankIndex | None
    sizes: DataFrame | None = None
    kinds: dict[str, str] = field(default_factory=dict)
    declared: dict[str, str] = field(default_factory=dict)
    roles: DataFrame | None = None


def profile_baseline(df: DataFrame, numeric: list[str], categorical: list[str]) -> Baseline:
    """Profile once; the tables are written out, so no later job reads the baseline again."""
    types = {f.name: f.dataType for f in df.schema}
    index = rank_index(df, numeric) if numeric else None
    profile = stored_profile(profile_index(index)) if numeric else None
    categories = sizes = None
    if categorical:
        counts = materialise(D.category_state(df, categorical, []), "profile-categories")
        categories = C.category_baseline(counts.where("category IS NOT NULL"))
        sizes = local_copy(counted_summary(counts, ["feature"]))
    return Baseline(
        numeric, categorical, profile, categories, index, sizes,
        {f: dtype_kind(types[f]) for f in [*numeric, *categorical]},
        {f: types[f].simpleString() for f in categorical})


@dataclass
class MonitoringResult:
    runs: DataFrame
    feature_results: DataFrame
    quality_reports: DataFrame
    quality_columns: DataFrame
    performance: DataFrame
    mix: DataFrame
    confusion: DataFrame
    feature_summaries: DataFrame | None = None
    unseen_values: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        """What to store; a run without categorical features has no unseen values."""
        found = {"runs": self.runs, "feature_results": self.feature_results,
                 "quality_reports": self.quality_reports, "quality_columns": self.quality_columns,
                 "performance": self.performance, "mix": self.mix, "confusion": self.confusion,
                 "feature_summaries": self.feature_summaries, "unseen_values": self.unseen_values}
        return {name: table for name, table in found.items() if table is not None}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_monitoring(batches: DataFrame, baseline: Baseline, keys: list[str], prediction: Column,
                   target: str | None = None, labels: list | None = None,
                   positive: str | None = None, baseline_mix: DataFrame | None = None,
                   reference_accuracy: float | None = None,
                   thresholds: dict | None = None) -> MonitoringResult:
    """Monitor every batch of the table in one go.

    Rows are read by four aggregations, each over its own columns: value counts, category state, row
    digests and outcomes. What they leave is written to the shared folder, since every result table is
    derived from it and none should read the rows again.
    """
    here = set(batches.columns)
    num = [f for f in baseline.numeric if f in here]
    cat = [f for f in baseline.categorical if f in here]
    if not baseline.numeric and not baseline.categorical:
        raise ValueError("the baseline has no features to monitor")
    truth = target if target in here else None
    scored = batches.withColumn("_prediction", prediction).withColumn(
        "_truth", F.col(truth) if truth else F.lit(None).cast("string"))
    outcomes = materialise(P.outcome_counts(scored, keys, "_truth", "_prediction"), "outcomes")
    duplicates = materialise(Q.duplicate_rows(batches, keys), "duplicates")
    values = materialise(D.value_counts(numeric_long(batches, num, keys), keys), "value-counts") if num else None
    state = materialise(D.category_state(batches, cat, keys, baseline.declared), "category-state") if cat else None
    gone = [(f, S.NUMERIC) for f in baseline.numeric if f not in here] + [
        (f, S.CATEGORICAL) for f in baseline.categorical if f not in here]
    absent = D.absent_features(duplicates.select(*keys), gone, keys) if gone else None
    limits = {**S.THRESHOLDS, **(thresholds or {})}
    models = duplicates.select(*keys).withColumn("reference_accuracy", F.lit(reference_accuracy).cast("double")).withColumn(
        "thresholds", F.struct(*[F.lit(float(v)).alias(k) for k, v in limits.items()]))
    return derive(values, state, duplicates, outcomes, baseline, keys, models, absent, labels, positive, baseline_mix,
                  thresholds, Q.static_mismatches(batches, baseline.kinds))


def derive(values: DataFrame | None, state: DataFrame | None, duplicates: DataFrame, outcomes: DataFrame,
           baseline: Baseline, keys: list[str], models: DataFrame, absent: DataFrame | None,
           labels: list | DataFrame | None, positive: str | DataFrame | None, baseline_mix: DataFrame | None,
           thresholds: dict | DataFrame | None, kinds: dict | None) -> MonitoringResult:
    """All result tables of a run from its aggregated states; no raw row is read.

    ``values`` and ``state``, both stored, count numeric values and categories, ``models`` gives reference_accuracy and thresholds
    per model or batch. With a baseline of many models, ``keys`` and the tables carry the model's key.
    """
    results, columns, unseen_values, numbers = [], [], None, None
    if values is not None:
        numbers = materialise(D.numeric_state_of(values, baseline.profile, keys), "numeric-state")
        ks = ks_of_counts(D.known_counts(values, keys), baseline.index, keys)
        drift = D.numeric_drift(numbers, baseline.profile, ks, keys, thresholds)
        results.append(E.explain_numeric(drift, numbers, baseline.profile, keys, thresholds))
        columns.append(Q.numeric_quality(numbers, keys, kinds))
    if state is not None:
        present = state.filter(F.col("category").isNotNull())
        # explanations look at the results several times
        drift = materialise(D.categorical_drift(state, baseline.categories, keys, thresholds),
                            "categorical-drift")
        unseen_values = materialise(C.unseen_categories(present, baseline.categories, keys), "unseen")
        results.append(E.explain_categorical(
            drift, state, baseline.categories, unseen_values, keys, thresholds))
        columns.append(Q.categorical_quality(state, baseline.categories, keys, kinds))
    if absent is not None:
        results.append(E.explain_absent(with_limits(absent, thresholds)))

    features = materialise(_union(results).drop("thresholds"), "features")
    quality_columns = _union(columns) if columns else Q.no_columns(duplicates, keys)
    quality = Q.quality_report(quality_columns, duplicates, keys)
    rolled = D.drift_rollup(features, keys, thresholds).drop("thresholds")
    block = P.performance_block(outcomes, keys, labels, positive)
    mix = P.prediction_distribution(outcomes, keys, labels)
    joined = quality.select(*keys, "row_count", "quality_score").join(rolled, keys, "left").join(block, keys)
    if baseline_mix is not None:
        joined = joined.join(H.mix_divergence(outcomes, baseline_mix, keys), keys, "left")
    else:
        joined = joined.withColumn("mix_jsd", F.lit(None).cast("double"))
    # the limits the run was judged by stay with it
    joined = joined.join(models, [k for k in keys if k in models.columns])
    runs = H.health_score(joined)
    return MonitoringResult(
        runs, features, quality, quality_columns, block, mix, outcomes,
        summaries(values, state, baseline, keys, numbers) if values is not None or state is not None else None, unseen_values)


def summaries(values: DataFrame | None, state: DataFrame | None, baseline: Baseline, keys: list[str],
              numbers: DataFrame | None = None) -> DataFrame:
    """Baseline and current side of every feature result as a reader of the stored run shows them.

    keys, feature, and a struct each: n, missing, missing_pct, mean, std, min, q1, median, q3, max, bin_edges and
    bin_counts of numeric features; n, missing, missing_pct and n_unique of categorical ones. The counts that the
    results came from hold all of it. ``numbers`` is the numeric state of ``values``, if there already.
    """
    numeric = ["mean", "std", "min", "q1", "median", "q3", "max"]
    both = ["n", "missing", "missing_pct"]
    lists = {"bin_edges": "array<double>", "bin_counts": "array<bigint>"}
    null = {**{c: F.lit(None).cast("double") for c in numeric}, **{c: F.lit(None).cast(t) for c, t in lists.items()},
            "n_unique": F.lit(None).cast("long")}

    def side(known: dict[str, Column]) -> Column:
        given = {**null, **known}
        return F.struct(*[given[c].alias(c) for c in (*both, *numeric, *lists, "n_unique")])

    parts = []
    if values is not None:
        on = D.profiled_on(baseline.profile, keys)
        group = [*keys, "feature"]
        state_of = D.numeric_state_of(values, baseline.profile, keys) if numbers is None else numbers
        q = counted_quantiles(values.filter(F.col("value").isNotNull()).select(*group, F.col("value").alias("_v"),
                                                                                F.col("n").alias("_c")), group, [0.25, 0.5, 0.75])
        current = state_of.join(q, group, "left").join(near(baseline.profile.select(*on, "bin_edges")), on).withColumn(
            "missing", F.col("rows") - F.col("n")).select(*group, side({
                **{c: F.col(c) for c in ("n", "missing", "mean", "std", "min", "max", "bin_edges", "bin_counts")},
                "missing_pct": pct(F.col("missing"), F.col("rows")),
                **{c: F.get("quantiles", F.lit(i)) for i, c in enumerate(("q1", "median", "q3"))}}).alias("current"))
        base = baseline.profile.select(*on, side({
            c: F.col(c) for c in (*both, *numeric, *lists)}).alias("baseline"))
        parts.append(current.join(near(base), on))
    if state is not None:
        sizes = D.category_sizes(state, keys)
        current = sizes.select(*keys, "feature", side({
            "n": F.col("n"), "missing": F.col("missing"), "missing_pct": pct(F.col("missing"), F.col("rows")),
            "n_unique": F.col("n_unique")}).alias("current"))
        base = baseline.sizes.select(*baseline.categories.keys, side({
            c: F.col(c) for c in (*both, "n_unique")}).alias("baseline"))
        parts.append(current.join(base, baseline.categories.keys))
    return _union(parts)
