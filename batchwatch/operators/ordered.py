"""Look-back and running sums over long per-key histories, without one task per key.

A window partitioned by key alone puts a key's whole history into one task. Here the history is
cut into slices. Inside a slice an ordinary window does the work; between slices only one
summary row per (key, slice) is carried forward. Slices come from range partitioning on key and order, so they
hold about as many rows each however the rows lie in time: a key with most rows in one hour is cut like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def in_ranges(df: DataFrame, keys: list[str], order: list[str], out: str = "_range") -> DataFrame:
    """The rows, stored, with the number of their range of (keys, order); ranges are numbered in that order.

    The order has to be unique within a key for a hot key to be cut. Ranges are found by sampling sizes, rows are
    all kept.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *keys, *order).withColumn(out, F.spark_partition_id()), "ranges")


def previous_values(df: DataFrame, keys: list[str], order: list[str], slice_by: Column | None,
                    values: dict[str, str]) -> DataFrame:
    """Add, for each {out: column}, the column of the row before in the key's order.

    Without ``slice_by``, a column that grows with the order, slices are ranges found here.
    """
    part = [*keys, "_slice"]
    sliced = in_ranges(df, keys, order, "_slice") if slice_by is None else df.withColumn("_slice", slice_by)
    w = Window.partitionBy(*part).orderBy(*order)
    payload = F.struct(*[F.col(c).alias(out) for out, c in values.items()])
    local = sliced.withColumn("_prev", F.lag(payload).over(w))
    last = (sliced.groupBy(*part).agg(F.max_by(payload, F.struct(*order)).alias("_last"))
            .withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")))
            .select(*part, "_carried"))
    joined = local.join(last, part, "left")
    chosen = F.coalesce("_prev", "_carried")
    return joined.select(*df.columns, *[chosen[out].alias(out) for out in values])


def running_sums(df: DataFrame, keys: list[str], order: list[str], slice_by: Column | None,
                 sums: dict[str, Column]) -> DataFrame:
    """Add, for each {out: expression}, its running sum up to and including the row."""
    part = [*keys, "_slice"]
    sliced = in_ranges(df, keys, order, "_slice") if slice_by is None else df.withColumn("_slice", slice_by)
    sliced = sliced.select(
        "*", *[e.alias(f"_v_{out}") for out, e in sums.items()])
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(f"_v_{out}").over(w).alias(f"_s_{out}") for out in sums])
    before = (Window.partitionBy(*keys).orderBy("_slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (sliced.groupBy(*part).agg(*[F.sum(f"_v_{out}").alias(f"_t_{out}") for out in sums])
               .select(*part, *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0))
                                .alias(f"_o_{out}") for out in sums]))
    joined = local.join(offsets, part, "left")
    return joined.select(*df.columns, *[
        (F.col(f"_s_{out}") + F.col(f"_o_{out}")).alias(out) for out in sums])


def positions(df: DataFrame, keys: list[str], order: list[str], slice_by: Column | None = None,
              out: str = "position") -> DataFrame:
    """1, 2, 3, ... in the key's order."""
    return running_sums(df, keys, order, slice_by, {out: F.lit(1).cast("long")})


def newest(df: DataFrame, keys: list[str], order: list[str], k: int = 1) -> DataFrame:
    """The k newest rows per key. The row limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def attach_positions(df: DataFrame, keys: list[str], order: list[str], slice_by: Column | None = None) -> DataFrame:
    """position plus the size of the key's history."""
    numbered = positions(df, keys, order, slice_by)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("size"))
    return numbered.join(sizes, keys)
