"""A stored index of a baseline's ranks.

The distinct values of every feature are counted once, dealt into value ranges and packed into sorted pages of
``PAGE`` values with running counts.  Pages of first values lie above them, up to one page per feature, so the rank
of any value is found by one equi-join per level and comparisons inside a page.  The lowest level is stored
bucketed by page: a look-up shuffles the values asked for and never the index.  Quantiles are read from the same
pages.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import local_copy, materialise, near, scratch
from .longform import numeric_long

#: a page holds SIDE x SIDE values
SIDE = 32
#: values asked for in one page beyond which the page is joined apart, where Spark can split it
BUSY_PAGE = 100_000


@dataclass
class RankIndex:
    """counts: (group, value, n) with null for missing values.  totals: group, n, distinct, missing.

    levels: pages from the lowest up; (group, page, vals) and in the lowest also upto (running counts over the
    group), before (the count below the page) and until (the count up to its end).
    """

    counts: DataFrame
    totals: DataFrame
    levels: list[DataFrame]
    group: list[str]
    side: int


def _stored_pages(pages: DataFrame, by: list[str]) -> DataFrame:
    """The pages as a bucketed table in the shared folder."""
    spark = pages.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"rank_pages_{uuid.uuid4().hex}"
    pages.repartition(buckets, *by).write.bucketBy(buckets, *by).option("path", scratch(spark, name)).saveAsTable(name)
    return spark.table(name)


def build_index(long: DataFrame, group: list[str], side: int = SIDE) -> RankIndex:
    """The index of ``long`` (group columns, value); null values count as missing only."""
    page = side * side
    ranged = materialise(long.groupBy(*group, "value").agg(F.count("*").alias("n")).repartitionByRange(
        *group, "value").withColumn("_slice", F.spark_partition_id()), "value-counts")
    own = ", ".join(f"`{k}`" for k in group)
    known = ranged.where("value IS NOT NULL")
    slices = known.groupBy(*group, "_slice").agg(F.sum("n").alias("_n"), F.count("*").alias("_d")).selectExpr(
        *[f"`{k}`" for k in group], "_slice", f"sum(_n) OVER (PARTITION BY {own} ORDER BY _slice) - _n AS _before",
        f"sum(_d) OVER (PARTITION BY {own} ORDER BY _slice) - _d AS _place")
    placed = known.selectExpr(
        "*", f"sum(n) OVER (PARTITION BY {own}, _slice ORDER BY value) AS _upto",
        f"row_number() OVER (PARTITION BY {own}, _slice ORDER BY value) AS _at").join(slices, [*group, "_slice"]).selectExpr(
        *[f"`{k}`" for k in group], "value", "n", "_before + _upto AS upto", "_place + _at - 1 AS place")
    entries = F.array_sort(F.collect_list(F.struct("value", "upto")))  # at most a page
    lowest = placed.groupBy(*group, F.expr(f"place div {page}").alias("page")).agg(
        entries.alias("_e"), F.min(F.col("upto") - F.col("n")).alias("before"), F.max("upto").alias("until")).select(
        *group, "page", F.col("_e.value").alias("vals"), F.col("_e.upto").alias("upto"), "before", "until")
    levels = [_stored_pages(lowest, [*group, "page"])]
    totals = local_copy(ranged.groupBy(*group).agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n"),
        F.count("value").alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing")))
    pages = -(-(totals.agg(F.max("distinct")).first()[0] or 0) // page)
    while pages > 1:
        firsts = levels[-1].select(*group, "page", F.get("vals", F.lit(0)).alias("value"))
        levels.append(materialise(firsts.groupBy(*group, F.expr(f"page div {page}").alias("_above")).agg(
            F.array_sort(F.collect_list(F.struct("page", "value"))).alias("_e")).select(
            *group, F.col("_above").alias("page"), F.col("_e.value").alias("vals")), "rank-pages"))
        pages = -(-pages // page)
    return RankIndex(ranged.select(*group, "value", "n"), totals, levels, group, side)


def rank_index(base: DataFrame, features: list[str], side: int = SIDE) -> RankIndex:
    """The index of a wide table's numeric features."""
    return build_index(numeric_long(base, features, []).select("feature", "value"), ["feature"], side)


def _found(pages: DataFrame, value: str, side: int) -> DataFrame:
    """``_at``: the place in ``vals`` of the largest value up to ``value``; 0 also where all are larger.

    One comparison a halving, each in a projection of its own: a single expression over all places of a page grows
    past the 8,000 bytes of code up to which the JVM compiles a method. Places beyond the end are null.
    """
    found, step = pages.withColumn("_at", F.lit(0)), 1 << (side * side - 1).bit_length()
    while step := step >> 1:
        found = found.withColumn("_at", F.expr(f"CASE WHEN {value} >= get(vals, _at + {step}) THEN _at + {step} ELSE _at END"))
    return found


def page_of(asked: DataFrame, index: RankIndex) -> DataFrame:
    """``asked`` (index group columns, value, ...) with the page of the lowest level that its value falls into.

    Page p takes the values from its first to that of page p + 1, page 0 also what is less than all.
    """
    group, page = index.group, index.side * index.side
    at = asked.withColumn("page", F.lit(0).cast("long"))
    for level in index.levels[:0:-1]:
        # one row per feature or per million values, of 8 KB; a shuffle would deal all values to as few keys
        at = _found(at.join(near(level, 1000), [*group, "page"]), "value", index.side).withColumn(
            "page", F.col("page") * page + F.col("_at")).select(*asked.columns, "page")
    return at


def rank_of(asked: DataFrame, index: RankIndex, busy: int = BUSY_PAGE) -> DataFrame:
    """``asked`` (index group columns, value, ...) with below and upto: how many indexed values are less, how many not more.

    Values of groups that the index lacks are left out.
    """
    return rank_in(page_of(asked, index), index, busy).drop("page")


def rank_in(at: DataFrame, index: RankIndex, busy: int = BUSY_PAGE) -> DataFrame:
    """``rank_of`` of values whose page is known."""
    lowest, key = index.levels[0], [*index.group, "page"]
    if len(index.levels) > 1:
        # bucketed pages are not split, so a page that very many values fall into is joined by itself
        at = materialise(at, "asked")
        crowded = materialise(at.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > busy).select(*key), "busy")
        if crowded.isEmpty():
            joined = at.join(lowest, key)
        else:
            joined = at.join(crowded, key, "left_anti").join(lowest, key).unionByName(
                at.join(lowest.join(F.broadcast(crowded), key, "left_semi"), key))
    else:
        joined = at.join(lowest, key)
    upto = "CASE WHEN value >= get(vals, 0) THEN get(upto, _at) ELSE before END"
    below = f"CASE WHEN value = get(vals, _at) THEN coalesce(get(upto, _at - 1), before) ELSE {upto} END"
    return _found(joined, "value", index.side).select(
        *at.columns, F.expr(below).alias("below"), F.expr(upto).alias("upto"))


def quantiles_of(index: RankIndex, probs: list[float]) -> DataFrame:
    """group + ``quantiles``: one linearly interpolated value per probability, read from the pages that hold them."""
    wanted = ", ".join(f"struct({i} AS i, {j} AS j, {step}((n - 1) * {float(p)!r}D) AS h)"
                       for i, p in enumerate(probs) for j, step in enumerate(("floor", "ceil")))
    pages = index.levels[0].join(near(index.totals.select(*index.group, "n")), index.group)
    held = pages.withColumn("_q", F.expr(
        f"explode(filter(array({wanted}), q -> q.h >= before AND q.h < element_at(upto, -1)))"))
    value = "get(vals, size(filter(upto, u -> u <= _q.h)))"
    ends = held.withColumn("_v", F.expr(value)).groupBy(*index.group, "_q.i").agg(
        F.max("n").alias("_n"), F.max(F.when(F.col("_q.j") == 0, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_q.j") == 1, F.col("_v"))).alias("_hi"))
    at = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("i")) * (F.col("_n") - 1)
    valued = ends.withColumn("_x", F.col("_lo") + (at - F.floor(at)) * (F.col("_hi") - F.col("_lo")))
    return valued.groupBy(*index.group).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "_x"))), lambda s: s["_x"]).alias("quantiles"))


def moments_of(index: RankIndex, extra: list[Column] | None = None, on: DataFrame | None = None) -> DataFrame:
    """group + n, missing, mean, std (population), min, max of the indexed values; ``extra`` aggregates over ``on``."""
    rows = index.counts if on is None else on
    v, n = F.col("value"), F.when(F.col("value").isNotNull(), F.col("n"))
    mean = index.counts.groupBy(*index.group).agg((F.sum(v * n) / F.sum(n)).alias("_mean"))
    return rows.join(near(local_copy(mean)), index.group).groupBy(*index.group).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(v.isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.max("_mean").alias("mean"), F.sqrt(F.sum(n * F.pow(v - F.col("_mean"), 2)) / F.sum(n)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), *(extra or []))
