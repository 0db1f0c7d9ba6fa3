"""Two-sample Kolmogorov-Smirnov distance of every batch to the whole baseline.

Batch values are counted per distinct value and dealt to the pages of the baseline's stored rank index. Counts per
page give the exact distance at the ends of every page and a bound of it inside, so only pages whose bound reaches
the largest distance at an end can hold the largest of all; the others' values are not looked up. Between two
neighbouring baseline values only the first and the last batch value can be farthest apart, so counts are summed
per pair of ranks and the distance comes from running counts over those. Nothing is sampled, and a run costs
what the batches hold: the baseline is neither shuffled nor written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pvalues import ks_pvalue
from ..storage import materialise, near
from .longform import numeric_long
from .rank_index import RankIndex, page_of, rank_in


def ks_statistic(batches: DataFrame, reference: RankIndex, features: list[str], keys: list[str],
                 effective_size: int | None = None) -> DataFrame:
    """keys, feature, ks, p_value, n_reference, n_current.

    The p-value is taken at the true sizes; ``effective_size`` bounds the batch size it is taken at,
    for users who want large batches judged like smaller ones. Groups in which one side has no values
    yield no row.
    """
    counted = numeric_long(batches, features, keys).filter(F.col("value").isNotNull()).groupBy(
        *keys, "feature", "value").agg(F.count("*").alias("c"))
    return ks_of_counts(materialise(counted, "value-counts"), reference, keys, effective_size)


def _open_pages(at: DataFrame, reference: RankIndex, group: list[str]) -> DataFrame:
    """(group, page) that can hold the largest distance, with _before (the group's count below the page) and both sizes.

    ``at`` has group, page, c. In a page both shares only grow from their value at its start to that at its end. The
    rounded quotients and differences grow like the exact ones, so no page that holds the largest is missed.
    """
    own = ", ".join(f"`{k}`" for k in group)
    names = [f"`{k}`" for k in group]
    totals = near(reference.totals.where("n > 0").select(*reference.group, F.col("n").alias("n_reference")))
    ends = reference.levels[0].select(*reference.group, "page", "before", "until")
    pages = at.groupBy(*group, "page").agg(F.sum("c").alias("_m")).join(ends, [*reference.group, "page"]).join(
        totals, reference.group)
    running = pages.selectExpr(
        "*", f"sum(_m) OVER (PARTITION BY {own}) AS n_current",
        f"sum(_m) OVER (PARTITION BY {own} ORDER BY page) - _m AS _before")
    shares = running.selectExpr(
        *names, "page", "_before", "n_reference", "n_current", "before / n_reference AS _b0", "until / n_reference AS _b1",
        "_before / n_current AS _c0", "(_before + _m) / n_current AS _c1")
    return shares.selectExpr(
        "*", f"max(greatest(abs(_b0 - _c0), abs(_b1 - _c1))) OVER (PARTITION BY {own}) AS _reached").where(
        "greatest(_b1 - _c0, _c1 - _b0) >= _reached").select(*group, "page", "_before", "n_reference", "n_current")


def ks_of_counts(counted: DataFrame, reference: RankIndex, keys: list[str],
                 effective_size: int | None = None) -> DataFrame:
    """``ks_statistic`` of value counts (keys, the index's group columns, value, c), read twice: pass a stored table."""
    group = [*keys, *[g for g in reference.group if g not in keys]]
    at = page_of(counted, reference)
    pages = near(materialise(_open_pages(at, reference, group), "open-pages"))
    asked = at.join(pages.select(*group, "page"), [*group, "page"])
    placed = rank_in(asked, reference).groupBy(*group, "page", "below", "upto").agg(F.sum("c").alias("c"))
    own = ", ".join(f"`{k}`" for k in [*group, "page"])  # a page has at most twice its values in pairs of ranks
    seen = placed.withColumn("_seen", F.expr(f"sum(c) OVER (PARTITION BY {own} ORDER BY upto, below)")).join(
        pages, [*group, "page"]).withColumn("_seen", F.col("_before") + F.col("_seen"))
    gap = F.greatest(
        F.abs(F.col("upto") / F.col("n_reference") - F.col("_seen") / F.col("n_current")),
        F.abs(F.col("below") / F.col("n_reference") - (F.col("_seen") - F.col("c")) / F.col("n_current")))
    stat = seen.groupBy(*group).agg(
        F.max(gap).alias("ks"), F.max("n_reference").alias("n_reference"), F.max("n_current").alias("n_current"))
    size = "n_current" if effective_size is None else f"least(n_current, {effective_size}L)"
    return stat.withColumn("p_value", ks_pvalue("ks", "n_reference", size))
