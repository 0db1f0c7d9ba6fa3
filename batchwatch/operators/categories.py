"""Category distributions of many batches against one baseline, without aligning them.

Comparing every batch with every baseline category would multiply batches by categories. It is
not needed: a baseline category a batch does not contain contributes a term that depends on the
baseline only (up to one factor per batch). So each measure is

    sum over the categories the batch contains  +  baseline total  -  baseline part of those

and the only join is an equi-join of batch counts with baseline counts on (feature, category).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.divergence import clamp_unit, jsd_term, psi_term
from ..functions.pvalues import with_chi2_pvalue
from ..schemas import EPSILON, MIN_EXPECTED_CELL
from ..storage import local_copy, materialise

_EPS = f"{EPSILON:.4f}D"


def _absent(term, share: str) -> str:
    """A measure's term for a baseline share the batch lacks, times (1 + k*epsilon)."""
    return term(f"{share} + {_EPS}", _EPS)


@dataclass
class CategoryBaseline:
    """A baseline's category frequencies, prepared once and read by every comparison.

    counts: (feature, category, n). by_size: (feature, at, m, s): how many categories have the
    count ``at``, and their sum; a baseline of n rows has at most about sqrt(2n) different counts.
    totals: per feature the rows b0, the categories k0 and the measures' totals over absent
    categories, one row per feature.
    """

    counts: DataFrame
    by_size: DataFrame
    totals: DataFrame
    keys: list[str]


def category_baseline(counts: DataFrame, keys: list[str] | None = None) -> CategoryBaseline:
    """``counts`` should be a stored table: it is read once here and by every comparison."""
    keys = keys or ["feature"]
    by_size = counts.groupBy(*keys, F.col("n").alias("at")).agg(
        F.count("*").alias("m"), F.sum("n").alias("s"))
    w = Window.partitionBy(*keys)
    totals = by_size.withColumns({"b0": F.sum("s").over(w), "k0": F.sum("m").over(w)}).groupBy(*keys).agg(
        F.max("b0").alias("b0"), F.max("k0").alias("k0"),
        F.expr(f"sum(m * ({_absent(psi_term, 'at / b0')}))").alias("w_psi"),
        F.expr(f"sum(m * ({_absent(jsd_term, 'at / b0')}))").alias("w_jsd"))
    return CategoryBaseline(counts, by_size, local_copy(totals), keys)


def baseline_shares(base: CategoryBaseline) -> DataFrame:
    """(feature, category, b, p, k0): counts, proportions and the number of categories."""
    return base.counts.join(base.totals, base.keys).select(
        *base.keys, "category", F.col("n").alias("b"), (F.col("n") / F.col("b0")).alias("p"), "k0")


def _sizes(batch_counts: DataFrame, totals: DataFrame, group: list[str],
           feature_keys: list[str]) -> DataFrame:
    """Totals of both sides per batch and feature, and the count a category needs to be kept."""
    return batch_counts.groupBy(*group).agg(F.sum("n").alias("c0")).join(
        totals, feature_keys, "left").fillna(0, ["b0", "k0", "w_psi", "w_jsd"]).withColumn(
        "limit", F.expr(
            f"CASE WHEN least(b0, c0) > 0 THEN ceil({MIN_EXPECTED_CELL} * (b0 + c0) / least(b0, c0)) END"))


def _cells(batch_counts: DataFrame, base_counts: DataFrame, group: list[str],
           feature_keys: list[str], sizes: DataFrame) -> DataFrame:
    """Every category of every batch with its baseline count b (0 if unseen) and all totals."""
    base = base_counts.select(*feature_keys, "category", F.col("n").alias("b"))
    return (batch_counts.withColumnRenamed("n", "c")
            .join(base, [*feature_keys, "category"], "left").join(sizes, group)
            .withColumns({"seen": F.col("b").isNotNull(), "b": F.coalesce("b", F.lit(0))})
            .withColumns({
                "p": F.expr("CASE WHEN seen THEN b / b0 ELSE 0.0D END"), "q": F.expr("c / c0"),
                "kept": F.expr("coalesce(b + c >= limit, false)"),
                "base_kept": F.expr("coalesce(b >= limit, false)"),
                # squared difference of observed and expected: the same in both rows of a column
                "dev2": F.expr("pow(b - CAST(b0 AS DOUBLE) * (b + c) / (b0 + c0), 2.0D)")}))


def _divergence_sums() -> list:
    psi, jsd = (f"sum({term(f'p + {_EPS}', f'q + {_EPS}')} - CASE WHEN seen THEN {_absent(term, 'p')} ELSE 0.0D END)"
                for term in (psi_term, jsd_term))
    return [F.expr(psi).alias("d_psi"), F.expr(jsd).alias("d_jsd"),
            F.count_if(~F.col("seen")).alias("n_unseen"),
            *[F.max(c).alias(c) for c in ("c0", "b0", "k0", "w_psi", "w_jsd")]]


def _divergence_columns() -> list:
    scale = f"(1.0D + (k0 + n_unseen) * {_EPS})"
    return [F.expr(f"greatest(0.0D, (w_psi + d_psi) / {scale})").alias("psi"),
            F.expr(clamp_unit(f"(w_jsd + d_jsd) / {scale}")).alias("jsd"),
            "n_unseen", F.col("c0").alias("n_current")]


def category_divergence(batch_counts: DataFrame, base: CategoryBaseline, keys: list[str]) -> DataFrame:
    """keys + feature: psi, jsd, n_unseen, n_current over the union of category sets.

    ``batch_counts`` has keys, feature, category, n and should be a stored table.
    """
    group = [*keys, *[k for k in base.keys if k not in keys]]
    sizes = materialise(_sizes(batch_counts, base.totals, group, base.keys), "category-sizes")
    cells = _cells(batch_counts, base.counts, group, base.keys, sizes)
    return cells.groupBy(*group).agg(*_divergence_sums()).select(*group, *_divergence_columns())


def category_scores(batch_counts: DataFrame, base: CategoryBaseline, keys: list[str]) -> DataFrame:
    """keys + feature: psi, jsd, chi2, p_value, columns, n_unseen, n_current.

    Chi-square is the 2 x k independence test of batch and baseline. Categories whose smaller
    expected cell is under five are pooled first, that is, those whose two counts together stay
    under a limit set by the two totals. A category only the baseline has is judged by its
    baseline count alone, so how many of those reach the limit, and their sum, comes from the
    baseline's running totals by count. With two columns left, Yates' correction takes up to one
    half off the deviation, which is the same in all four cells.
    """
    group = [*keys, "feature"]
    sizes = _sizes(batch_counts, base.totals, group, base.keys)
    # the look-up joins the small table of totals, which is stored before the categories meet it:
    # its size then lets Spark broadcast it, and a feature with very many categories is summed up
    # before the shuffle
    sizes = materialise(sizes.join(_reached(sizes, base.by_size, base.keys), [*base.keys, "limit"], "left").fillna(
        0, ["reach_n", "reach_b"]), "category-sizes")
    cells = _cells(batch_counts, base.counts, group, base.keys, sizes)
    column_chi = "dev2 * (CAST(b0 + c0 AS DOUBLE) / (b + c)) * (1.0D / b0 + 1.0D / c0)"
    sums = cells.groupBy(*group).agg(
        *_divergence_sums(),
        F.count_if("kept").alias("kept_n"),
        F.expr("coalesce(sum(CASE WHEN kept THEN b END), 0)").alias("kept_b"),
        F.expr("coalesce(sum(CASE WHEN kept THEN c END), 0)").alias("kept_c"),
        F.expr(f"coalesce(sum(CASE WHEN kept THEN {column_chi} END), 0.0D)").alias("chi"),
        F.expr("coalesce(sum(CASE WHEN kept THEN dev2 END), 0.0D)").alias("dev2"),
        F.count_if("base_kept").alias("base_n"),
        F.expr("coalesce(sum(CASE WHEN base_kept THEN b END), 0)").alias("base_b"),
        F.max("reach_n").alias("reach_n"), F.max("reach_b").alias("reach_b"))
    step = sums.withColumns({
        "absent_n": F.expr("reach_n - base_n"), "absent_b": F.expr("reach_b - base_b"),
    }).withColumns({
        "pool_b": F.expr("b0 - kept_b - absent_b"), "pool_c": F.expr("c0 - kept_c"),
    }).withColumns({
        "pooled": F.expr("pool_b + pool_c > 0"),
        "pool_dev2": F.expr(
            "pow(pool_b - CAST(b0 AS DOUBLE) * (pool_b + pool_c) / (b0 + c0), 2.0D)"),
    }).withColumns({
        "columns": F.expr("kept_n + absent_n + CAST(pooled AS BIGINT)"),
    }).withColumns({
        "defined": F.expr("columns >= 2 AND b0 > 0 AND c0 > 0"),
    }).withColumns({
        # a kept column the batch lacks adds b * c0 / b0 to the statistic
        "chi": F.expr(
            "CASE WHEN defined THEN chi + CAST(absent_b AS DOUBLE) * c0 / b0 + CASE WHEN pooled THEN pool_dev2 * "
            "(CAST(b0 + c0 AS DOUBLE) / (pool_b + pool_c)) * (1.0D / b0 + 1.0D / c0) ELSE 0.0D END ELSE 0.0D END"),
        "dev": F.expr(
            "sqrt((dev2 + pow(CAST(absent_b AS DOUBLE) * c0 / (b0 + c0), 2.0D) "
            "+ CASE WHEN pooled THEN pool_dev2 ELSE 0.0D END) / 2.0D)"),
    }).withColumns({
        "chi2": F.expr(
            "CASE WHEN NOT defined THEN 0.0D WHEN columns > 2 THEN chi WHEN dev <= 0.5D THEN 0.0D "
            "ELSE chi * pow((dev - 0.5D) / dev, 2.0D) END"),
        "dof": F.expr("CASE WHEN defined THEN CAST(columns - 1 AS DOUBLE) ELSE 0.0D END"),
    })
    return with_chi2_pvalue(step, "chi2", "dof").select(
        *group, *_divergence_columns(), "chi2", "p_value", "columns")


def chi_square(batch_counts: DataFrame, base: CategoryBaseline, keys: list[str]) -> DataFrame:
    """keys + feature: chi2, p_value, columns after pooling, n_current."""
    return category_scores(batch_counts, base, keys).select(
        *keys, "feature", "chi2", "p_value", "columns", "n_current")


def _reached(sizes: DataFrame, by_size: DataFrame, on: list[str]) -> DataFrame:
    """(feature, limit) -> number and sum of baseline counts that reach the limit.

    One window over a feature's list of different counts and the limits its batches ask for.
    """
    limits = sizes.filter(F.col("limit").isNotNull()).select(*on, F.col("limit").alias("at")).distinct()
    both = by_size.select(*on, "at", "m", "s", F.lit(0).alias("asked")).unionByName(
        limits.selectExpr(*[f"`{k}`" for k in on], "at", "0L AS m", "0L AS s", "1 AS asked"))
    w = (Window.partitionBy(*on).orderBy(F.desc("at"), "asked")
         .rowsBetween(Window.unboundedPreceding, 0))
    running = both.withColumns({"reach_n": F.sum("m").over(w), "reach_b": F.sum("s").over(w)})
    return running.filter(F.col("asked") == 1).select(
        *on, F.col("at").alias("limit"), "reach_n", "reach_b")


def unseen_categories(batch_counts: DataFrame, base: CategoryBaseline, keys: list[str]) -> DataFrame:
    """keys, feature, category, n of categories the baseline never had."""
    known = base.counts.select(*base.keys, "category")
    return batch_counts.join(known, [*base.keys, "category"], "left_anti").select(
        *keys, "feature", "category", "n")


def aligned_categories(batch_counts: DataFrame, base: CategoryBaseline, keys: list[str]) -> DataFrame:
    """Full outer alignment of every batch with the baseline, missing side 0.

    The result has a row per batch and baseline category; scores do not need it (see above), only
    displays of whole distributions do.
    """
    counted = batch_counts.select(*keys, "feature", "category", F.col("n").alias("n_current"))
    known = base.counts.select("feature", "category", F.col("n").alias("n_baseline"))
    expected = counted.select(*keys, "feature").distinct().join(known, "feature")
    return expected.join(counted, [*keys, "feature", "category"], "full").select(
        *keys, "feature", "category",
        F.coalesce("n_baseline", F.lit(0)).alias("n_baseline"),
        F.coalesce("n_current", F.lit(0)).alias("n_current"))
