"""Exact interpolated quantiles per group, whatever the size of the group.

Values are counted per distinct value. Counts per rough step of size tell which steps hold the wanted ranks, and only
their values are dealt into ranges; counts per range tell the rank at which a range starts, so running counts inside
ranges find the values. No task sorts a whole group, and values that all fall into one step go the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import local_copy, materialise, near

#: never falls as ``_v`` grows; about 590 steps between two powers of ten
_STEP = "floor(least(log1p(abs(CAST(_v AS DOUBLE))), 1e6D) * 256) * CASE WHEN _v < 0 THEN -1L ELSE 1L END"


def exact_quantiles(long: DataFrame, keys: list[str], probs: list[float], value: str = "value") -> DataFrame:
    """keys + ``quantiles``: one linearly interpolated value per probability."""
    return counted_quantiles(materialise(long.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull()).groupBy(
        *keys, "_v").agg(F.count("*").alias("_c")), "value-counts"), keys, probs)


def counted_quantiles(counted: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """``exact_quantiles`` of counts (keys, _v, _c) of distinct values, read twice: pass a stored table."""
    own = ", ".join(f"`{k}`" for k in keys)
    # the two ranks around each probability; a value holds the ranks upto - c .. upto - 1
    wanted = ", ".join(f"struct({i} AS i, {j} AS j, {step}((_n - 1) * {float(p)!r}D) AS h)"
                       for i, p in enumerate(probs) for j, step in enumerate(("floor", "ceil")))
    rough = counted.select(*keys, "_v", "_c", F.expr(_STEP).alias("_step"))
    steps = rough.groupBy(*keys, "_step").agg(F.sum("_c").alias("_m")).selectExpr(
        *[f"`{k}`" for k in keys], "_step", "_m", f"sum(_m) OVER (PARTITION BY {own}) AS _n",
        f"sum(_m) OVER (PARTITION BY {own} ORDER BY _step) - _m AS _start")
    hit = near(local_copy(steps.where(F.expr(
        f"exists(array({wanted}), q -> q.h >= _start AND q.h < _start + _m)")).drop("_m")))
    # stored first: finding the ranges reads its input once more
    around = materialise(rough.join(hit.select(*keys, "_step"), [*keys, "_step"]), "wanted-steps")
    ranged = materialise(around.repartitionByRange(*keys, "_v").withColumn("_slice", F.spark_partition_id()), "value-ranges")
    starts = ranged.groupBy(*keys, "_step", "_slice").agg(F.sum("_c").alias("_m")).selectExpr(
        *[f"`{k}`" for k in keys], "_step", "_slice",
        f"sum(_m) OVER (PARTITION BY {own}, _step ORDER BY _slice) - _m AS _before").join(hit, [*keys, "_step"])
    ranked = ranged.withColumn(
        "_upto", F.expr(f"sum(_c) OVER (PARTITION BY {own}, _step, _slice ORDER BY _v)")).join(
        starts, [*keys, "_step", "_slice"]).withColumn("_upto", F.expr("_start + _before + _upto"))
    held = ranked.withColumn("_q", F.expr(
        f"explode(filter(array({wanted}), q -> q.h >= _upto - _c AND q.h < _upto))"))
    ends = held.groupBy(*keys, "_q.i").agg(
        F.max("_n").alias("_n"), F.max(F.when(F.col("_q.j") == 0, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_q.j") == 1, F.col("_v"))).alias("_hi"))
    at = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("i")) * (F.col("_n") - 1)
    valued = ends.withColumn("_x", F.col("_lo") + (at - F.floor(at)) * (F.col("_hi") - F.col("_lo")))
    # one entry per probability: an array of at most len(probs) values
    return valued.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "_x"))), lambda s: s["_x"]).alias("quantiles"))
