"""Exact-size deterministic samples without sorting whole groups.

Rows are ordered by ``md5(seed|row key)`` and the first k of every group are taken. Sorting a
group to find them would put a hot group into one task, so the cut is found in two steps: counts
per hash prefix (a small aggregate that collapses map-side) tell in which prefix the k-th row
lies, and only the rows of that prefix are ranked. A hot group of n rows ranks about n / 65,536.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import REFERENCE_CAP, SEED
from ..storage import materialise

_PREFIX = 4
#: rows with the same leading digits that are sorted at once
_FEW = 10_000
_ABOVE_ALL = "g"  # sorts after every hexadecimal digit


def row_hash(seed: int | str, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def half_even_share(n: Column, rate: float) -> Column:
    """round(n * rate), half to even, never more than n."""
    return F.bround(n * F.lit(float(min(max(rate, 0.0), 1.0))), 0).cast("long")


def hash_cuts(df: DataFrame, keys: list[str], seed: int | str, row_key: list[str],
              wanted: Column) -> DataFrame:
    """Per group: its size ``n`` and ``cut``, the hash of the last row to take (null = none).

    ``wanted`` is a Column over ``n`` and the group keys. Row keys must be unique in a group.
    """
    hashed = df.select(*keys, row_hash(seed, *row_key).alias("_h")).withColumn(
        "_p", F.substring("_h", 1, _PREFIX))
    per_prefix = hashed.groupBy(*keys, "_p").agg(F.count("*").alias("_c"))
    sizes = per_prefix.groupBy(*keys).agg(F.sum("_c").alias("n")).withColumn("_k", wanted)
    boundary = _boundary(per_prefix.join(sizes, keys), keys, F.col("_k"))
    # one row per group: stored, so that its size decides how the rows meet it
    boundary = materialise(boundary, "sample-boundary")
    finer = hashed.join(boundary, [*keys, "_p"]).withColumn("_p", F.substring("_h", 1, 2 * _PREFIX))
    counted = finer.groupBy(*keys, "_p").agg(F.count("*").alias("_c"), F.max("_need").alias("_k"))
    boundary = materialise(_boundary(counted, keys, F.col("_k")), "sample-boundary")
    inside = hashed.withColumn("_p", F.substring("_h", 1, 2 * _PREFIX)).join(boundary, [*keys, "_p"])
    rank = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_h"))
    cuts = (inside.withColumn("_r", rank).filter(F.col("_r") == F.col("_need"))
            .select(*keys, F.col("_h").alias("cut")))
    # wanting every row needs no boundary row
    return sizes.join(cuts, keys, "left").select(
        *keys, "n", F.col("_k").alias("k"),
        F.when(F.col("_k") >= F.col("n"), F.lit(_ABOVE_ALL)).otherwise(F.col("cut")).alias("cut"))


def _boundary(counts: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """keys, _p, _need: the prefix in which the wanted row lies and its place among the prefix's rows."""
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_c")
    return counts.withColumn("_before", before).filter(
        (F.col("_before") < wanted) & (F.col("_before") + F.col("_c") >= wanted)).select(
        *keys, "_p", (wanted - F.col("_before")).alias("_need"))


def table_cut(df: DataFrame, seed: int | str, row_key: list[str], wanted: int) -> str | None:
    """The cut of a whole table as a single value: the hash is read four digits further each time.

    Each step counts the next digits of the rows that share the digits so far, 65,536 counts at most.
    """
    if wanted <= 0:
        return None
    inside, need, digits = df.select(row_hash(seed, *row_key).alias("_h")), wanted, 0
    while True:
        digits += _PREFIX
        counts = inside.withColumn("_p", F.substring("_h", 1, digits)).groupBy("_p").agg(F.count("*").alias("_c"))
        found = _boundary(counts, [], F.lit(need)).join(counts, "_p").first()
        if found is None:
            return _ABOVE_ALL
        if digits >= 32 or found["_c"] <= _FEW:
            break
        inside, need = inside.filter(F.col("_h").startswith(found["_p"])), found["_need"]
    last = inside.filter(F.col("_h").startswith(found["_p"])).orderBy("_h").limit(_FEW)
    return last.offset(found["_need"] - 1).first()["_h"] if digits < 32 else found["_p"]


def flag_sample(df: DataFrame, keys: list[str], seed: int | str, row_key: list[str],
                wanted: Column, flag: str = "picked") -> DataFrame:
    """Add a boolean: is this one of the first ``wanted`` rows of its group in hash order."""
    narrow = materialise(hash_cuts(df, keys, seed, row_key, wanted).select(
        *keys, F.col("cut").alias("_cut")), "sample-cuts")
    return df.join(narrow, keys, "left").withColumn(
        flag, F.coalesce(row_hash(seed, *row_key) <= F.col("_cut"), F.lit(False))).drop("_cut")


def flag_table_sample(df: DataFrame, seed: int | str, row_key: list[str], wanted: int,
                      flag: str = "picked") -> DataFrame:
    """The same over a whole table, where the size wanted is a number."""
    cut = table_cut(df, seed, row_key, wanted)
    return df.withColumn(flag, row_hash(seed, *row_key) <= cut if cut else F.lit(False))


def flag_share(df: DataFrame, keys: list[str], seed: int | str, row_key: list[str], rate: float,
               flag: str = "picked") -> DataFrame:
    """Flag round(n * rate) rows per group, or of the whole table where there are no keys."""
    if keys:
        return flag_sample(df, keys, seed, row_key, half_even_share(F.col("n"), rate), flag)
    return flag_table_sample(df, seed, row_key, round(df.count() * min(max(rate, 0.0), 1.0)), flag)


def take_table_sample(df: DataFrame, seed: int | str, row_key: list[str], wanted: int) -> DataFrame:
    return flag_table_sample(df, seed, row_key, wanted, "_picked").filter("_picked").drop("_picked")


def reference_sample(df: DataFrame, features: list[str], row_key: list[str],
                     cap: int = REFERENCE_CAP, seed: int = SEED) -> DataFrame:
    """At most ``cap`` raw feature rows, the lowest in hash order."""
    columns = [*row_key, *[f for f in features if f not in row_key]]
    # no choice to make for a table under the cap, which a count tells
    if df.limit(cap + 1).count() <= cap:
        return df.select(*columns)
    return take_table_sample(df, seed, row_key, cap).select(*columns)


def stratified_split(df: DataFrame, target: str, row_key: list[str], test_share: float = 0.25,
                     seed: int = SEED, names: tuple[str, str] = ("train", "test"),
                     out: str = "split") -> DataFrame:
    """Label rows train or test so that every class keeps its share."""
    share = half_even_share(F.col("n"), test_share)
    flagged = flag_sample(df, [target], seed, row_key, share, "_test")
    return flagged.withColumn(
        out, F.when(F.col("_test"), F.lit(names[1])).otherwise(F.lit(names[0]))).drop("_test")


def three_way_split(df: DataFrame, target: str, row_key: list[str], seed: int = SEED) -> DataFrame:
    """60/20/20 baseline, holdout, test; every class keeps its share.

    Both cuts are taken on one hash order, so one pass over the group counts is enough for each.
    """
    rest = half_even_share(F.col("n"), 0.4)
    test = F.bround(half_even_share(F.col("n"), 0.4) * 0.5, 0).cast("long")
    flagged = flag_sample(df, [target], seed, row_key, rest, "_rest")
    flagged = flag_sample(flagged, [target], seed, row_key, test, "_test")
    return flagged.withColumn(
        "split", F.when(F.col("_test"), "test").when(F.col("_rest"), "holdout")
        .otherwise("baseline")).drop("_rest", "_test")


def validation_sample(reference: DataFrame, features: list[str], row_key: list[str], n: int = 50,
                      seed: int = SEED) -> DataFrame:
    """The first n reference rows in hash order: what a new model has to score for admission."""
    return reference.orderBy(row_hash(seed, *row_key)).limit(n).select(*features)


def target_classes(df: DataFrame, target: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull()).select(
        F.col(target).cast("string").alias("label")).distinct()
