"""Plain-language explanation of every drift result."""

# Fixed texts: the sentences in this module are part of the results and have to stay as they are.
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions.status import Thresholds, thresholds_of
from ..storage import near
from .categories import CategoryBaseline, baseline_shares
from .drift import profiled_on

_POINTS = 0.5


def driving_measure(psi: Column, jsd: Column, t: Thresholds) -> Column:
    """Which measure crossed which threshold; HIGH before MODERATE, PSI before JSD. Null if none."""
    def crossed(name: str, value: Column, level: str) -> Column:
        return F.concat(
            F.lit(f"{name} is "), X.fixed(value, 3), F.lit(f", above the {level}-drift threshold of "),
            X.fixed(t[f"{name.lower()}_{level}"], 2))

    return (F.when(psi > t["psi_high"], crossed("PSI", psi, "high"))
            .when(jsd > t["jsd_high"], crossed("JSD", jsd, "high"))
            .when(psi >= t["psi_moderate"], crossed("PSI", psi, "moderate"))
            .when(jsd >= t["jsd_moderate"], crossed("JSD", jsd, "moderate")))


def significance_clause(p: Column, test: Column) -> Column:
    """Does the test confirm the shift? The sentence always speaks about 0.05."""
    label = F.when(test == S.KS, "K-S test").otherwise("Chi-Square test")
    return (
        F.when(p.isNull(), "")
        .when(p < 0.05, F.concat(F.lit(" The "), label, F.lit(" returns "), X.p_value(p),
                                 F.lit(", confirming the two distributions differ.")))
        .otherwise(F.concat(
            F.lit(" The "), label, F.lit(" returns "), X.p_value(p),
            F.lit(", so the difference is not statistically confirmed at this sample size — the "
                  "status has been reduced by one level as a precaution."))))


def _too_little(t: Thresholds) -> Column:
    return F.concat(
        F.lit("Not enough data to assess `"), F.col("feature"), F.lit("`. At least "),
        F.floor(t["min_samples"]).cast("string"),
        F.lit(" non-empty values are needed on both sides; this run had "),
        F.format_number("n_current", 0), F.lit(" in the batch."))


def _absent() -> Column:
    return F.concat(F.lit("`"), F.col("feature"), F.lit(
        "` was not present in this batch, so it could not be assessed."))


def numeric_text(t: Thresholds) -> Column:
    """Needs the drift result plus mean, std, missing_pct of both sides (base_*, cur_*)."""
    bm, cm = F.col("base_mean"), F.col("cur_mean")
    bs, cs = F.col("base_std"), F.col("cur_std")
    known = bm.isNotNull() & cm.isNotNull()
    change = 100.0 * (cm - bm) / F.abs(bm)
    moved = F.concat(
        F.lit("The average "), F.when(cm > bm, "rose").otherwise("fell"), F.lit(" from "),
        X.number(bm), F.lit(" in the baseline to "), X.number(cm), F.lit(" in this batch"),
        F.when(bm != 0, F.concat(F.lit(" ("), X.signed(change), F.lit("%)"))).otherwise(""))
    lead = F.concat(X.status_phrase(F.col("status")), F.lit(" detected in `"), F.col("feature"),
                    F.lit("`."))
    sentence = F.when(known, F.concat(lead, F.lit(" "), moved)).otherwise(lead)
    spread = F.when(bs != cs, F.concat(
        F.lit(", and the spread "), F.when(cs > bs, "widened").otherwise("narrowed"),
        F.lit(" (std "), X.number(bs), F.lit(" → "), X.number(cs), F.lit(").")))
    end = F.coalesce(spread, F.when(known, ".").otherwise(""))
    driver = F.coalesce(F.concat(
        F.lit(" "), driving_measure(F.col("psi"), F.col("jsd"), t), F.lit(".")), F.lit(""))
    bmiss = F.coalesce("base_missing_pct", F.lit(0.0))
    cmiss = F.coalesce("cur_missing_pct", F.lit(0.0))
    missing = F.when(cmiss - bmiss > 1.0, F.concat(
        F.lit(" Missing values also rose from "), X.percent(bmiss), F.lit(" to "), X.percent(cmiss),
        F.lit("."))).otherwise("")
    calm = F.concat(
        F.lit("No drift in `"), F.col("feature"), F.lit("`. The average is "), X.number(cm),
        F.lit(" against a baseline of "), X.number(bm), F.lit(", within normal variation."))
    return (F.when(F.col("status") == S.INSUFFICIENT, _too_little(t))
            .when(F.col("status") == S.NONE, calm)
            .otherwise(F.concat(sentence, end, driver,
                                significance_clause(F.col("p_value"), F.col("test_name")), missing)))


def top_movers(batch_counts: DataFrame, base: CategoryBaseline, keys: list[str],
               drifted: DataFrame | None = None) -> DataFrame:
    """Per batch and feature the two categories gaining and the two losing most share.

    Only moves of more than half a point count, so only categories holding more than half a
    percent on one side can appear: fewer than 200 per side. That keeps the comparison of batches
    with baseline categories short without looking at all pairs.
    """
    group = [*keys, "feature"]
    cur = batch_counts.join(
        batch_counts.groupBy(*group).agg(F.sum("n").alias("t")), group).select(
        *group, "category", (100.0 * F.col("n") / F.col("t")).alias("after"))
    shares = baseline_shares(base).select(
        *base.keys, "category", (100.0 * F.col("p")).alias("before"))
    asked = (drifted if drifted is not None else batch_counts).select(*group).distinct()
    major_list = shares.filter(F.col("before") > _POINTS).groupBy(*base.keys).agg(
        F.collect_list("category").alias("major"))  # fewer than 200 entries per feature
    from_base = asked.join(major_list if len(base.keys) > 1 else F.broadcast(major_list), base.keys).select(
        *group, F.explode("major").alias("category"))
    from_batch = cur.filter(F.col("after") > _POINTS).join(asked, group, "left_semi").select(
        *group, "category")
    candidates = from_base.unionByName(from_batch).distinct()
    moves = (candidates.join(cur, [*group, "category"], "left")
             .join(shares, [*base.keys, "category"], "left")
             .fillna(0.0, ["after", "before"]))
    delta = F.col("after") - F.col("before")
    w = Window.partitionBy(*group)
    ranked = moves.withColumn("delta", delta).withColumn(
        "rise", F.row_number().over(w.orderBy(F.desc("delta"), "category"))).withColumn(
        "fall", F.row_number().over(w.orderBy("delta", "category")))
    rising = (F.col("delta") > _POINTS) & (F.col("rise") <= 2)
    falling = (F.col("delta") < -_POINTS) & (F.col("fall") <= 2)
    return ranked.filter(rising | falling).select(
        *group, "category", F.when(rising, "up").otherwise("down").alias("direction"),
        F.when(rising, F.col("rise")).otherwise(F.col("fall")).cast("long").alias("place"),
        "before", "after", "delta")


def first_unseen(unseen: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The first k unseen values in order and how many more there are."""
    group = [*keys, "feature"]
    first = unseen.withColumn("r", F.row_number().over(
        Window.partitionBy(*group).orderBy("category"))).filter(F.col("r") <= k)
    listed = first.groupBy(*group).agg(
        F.array_sort(F.collect_list("category")).alias("first_values"))  # at most k values
    total = unseen.groupBy(*group).agg(F.count("*").alias("n_unseen"))
    return listed.join(total, group).withColumn(
        "more", F.greatest(F.col("n_unseen") - k, F.lit(0)))


def _mover_text(c: Column) -> Column:
    change = F.concat(F.lit(" ("), X.signed(c["delta"]), F.lit(" points)"))
    share = F.concat(X.percent(c["before"]), F.lit(" to "), X.percent(c["after"]), change)
    return F.when(c["direction"] == "up", F.concat(
        F.lit("the share of *"), c["category"], F.lit("* rose from "), share)).otherwise(
        F.concat(F.lit("*"), c["category"], F.lit("* fell from "), share))


def mover_sentences(movers: DataFrame, keys: list[str]) -> DataFrame:
    """One sentence per batch and feature from at most four movers."""
    entry = F.struct((F.col("direction") == "down").alias("last"), "place", "category",
                     "direction", "before", "after", "delta")
    per = movers.groupBy(*keys, "feature").agg(F.array_sort(F.collect_list(entry)).alias("m"))
    clauses = F.transform("m", _mover_text)
    joined = F.when(F.size("m") > 1, F.concat(
        F.element_at(clauses, 1), F.lit(" while "),
        F.array_join(F.slice(clauses, 2, 4), ", "))).otherwise(F.element_at(clauses, 1))
    capital = F.concat(F.upper(F.substring(joined, 1, 1)),
                       F.substr(joined, F.lit(2)), F.lit("."))
    return per.select(*keys, "feature", capital.alias("moved"))


def categorical_text(t: Thresholds) -> Column:
    """Needs the drift result plus moved, first_values, more and base_categories."""
    lead = F.concat(X.status_phrase(F.col("status")), F.lit(" detected in `"), F.col("feature"),
                    F.lit("`."))
    listed = F.array_join(F.transform("first_values", lambda v: F.concat(F.lit("*"), v, F.lit("*"))), ", ")
    unseen = F.concat(
        F.lit("The batch also contains "), listed,
        F.when(F.col("more") > 0, F.concat(F.lit(" and "), F.col("more").cast("string"),
                                           F.lit(" more"))).otherwise(""),
        F.lit(", which never appeared in the baseline data."))
    driver = F.concat(driving_measure(F.col("psi"), F.col("jsd"), t), F.lit("."))
    calm = F.concat(
        F.lit("No drift in `"), F.col("feature"),
        F.lit("`. Category proportions are close to the baseline across all "),
        F.coalesce("base_categories", F.lit(0)).cast("string"), F.lit(" categories."))
    return (F.when(F.col("status") == S.INSUFFICIENT, _too_little(t))
            .when(F.col("status") == S.NONE, calm)
            .otherwise(F.concat(
                F.concat_ws(" ", lead, F.col("moved"), unseen, driver),
                significance_clause(F.col("p_value"), F.col("test_name")))))


def explain_numeric(results: DataFrame, state: DataFrame, profile: DataFrame, keys: list[str],
                    thresholds: dict | None = None) -> DataFrame:
    t = thresholds_of(results, thresholds)
    on = profiled_on(profile, keys)
    cur = state.select(
        *keys, "feature", F.col("mean").alias("cur_mean"), F.col("std").alias("cur_std"),
        F.when(F.col("rows") > 0, F.bround(100.0 * (F.col("rows") - F.col("n")) / F.col("rows"), 4))
        .alias("cur_missing_pct"))
    base = near(profile.select(
        *on, F.col("mean").alias("base_mean"), F.col("std").alias("base_std"),
        F.col("missing_pct").alias("base_missing_pct")))
    joined = results.join(cur, [*keys, "feature"], "left").join(base, on, "left")
    return joined.select(*results.columns, numeric_text(t).alias("explanation"))


def explain_categorical(results: DataFrame, state: DataFrame, base: CategoryBaseline,
                        unseen: DataFrame, keys: list[str],
                        thresholds: dict | None = None) -> DataFrame:
    t = thresholds_of(results, thresholds)
    group = [*keys, "feature"]
    counts = state.filter(F.col("category").isNotNull())
    drifted = results.filter(F.col("status").isin(S.HIGH, S.MODERATE))
    movers = mover_sentences(top_movers(counts, base, keys, drifted), keys)
    first = first_unseen(unseen, keys).select(*group, "first_values", "more")
    known = base.totals.select(*base.keys, F.col("k0").alias("base_categories"))
    joined = (results.join(movers, group, "left").join(first, group, "left")
              .join(known, base.keys, "left"))
    return joined.select(*results.columns, categorical_text(t).alias("explanation"))


def explain_absent(results: DataFrame) -> DataFrame:
    return results.withColumn("explanation", _absent())
