"""Data-quality checks of every batch against the baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.values import FRACTIONAL, INTEGRAL, TEMPORAL, dtype_kind, half_even, pct
from .categories import CategoryBaseline, unseen_categories
from .drift import category_sizes


#: instead of kinds: every value arrived as text, so a numeric column mismatches when a value does not parse
BY_CONTENT = "content"


#: types hashed as they are; a value of any other becomes text first
_PLAIN = (T.BooleanType, *INTEGRAL, *FRACTIONAL, *TEMPORAL, T.BinaryType)


def _row_digest(df: DataFrame, columns: list[str]) -> list[Column]:
    """128 bits of a row, as two longs to shuffle instead of the row. Which cells are null is part of them.

    Two different rows among n have equal bits with a chance below n * n / 2 ** 128.
    """
    types = {f.name: f.dataType for f in df.schema}
    cells, nulls = [], []
    for i, name in enumerate(columns):
        c, kind = F.col(f"`{name}`"), types[name]
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c + F.lit(0.0))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(kind, T.StringType):
            c = c.cast("binary")
        elif not isinstance(kind, _PLAIN):
            c = F.to_json(F.struct(c.alias(name)))
        cells.append(c)
        # a hash passes over nulls, so they are told by bits
        nulls.append(F.when(c.isNull(), F.lit(1 << i % 62).cast("long")).otherwise(F.lit(0).cast("long")))
    marks = [reduce(Column.__add__, nulls[i:i + 62]) for i in range(0, len(nulls), 62)]
    return [F.xxhash64(F.lit(seed), *marks, *cells) for seed in (1, 2)]


def duplicate_rows(batches: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row of the batch in all its columns, nulls being equal.

    Copies collapse map-side, so a row that is repeated very often is no hot key.
    """
    columns = columns or [c for c in batches.columns if c not in keys]
    one, two = _row_digest(batches, columns)
    digests = batches.select(*keys, one.alias("_d1"), two.alias("_d2"))
    groups = digests.groupBy(*keys, "_d1", "_d2").agg(F.count("*").alias("c"))
    per = groups.groupBy(*keys).agg(
        F.sum("c").alias("row_count"), (F.sum("c") - F.count("*")).alias("duplicate_rows"))
    return per.withColumn("duplicate_pct", pct(F.col("duplicate_rows"), F.col("row_count")))


def static_mismatches(batches: DataFrame, expected: dict[str, str]) -> dict[str, tuple[str, str, bool]]:
    """feature -> (expected kind, actual kind, decided per batch).

    A numeric feature that arrives as text is judged by content: the batch mismatches when a
    value does not parse, which is when a reader inferring types would have called it text.
    """
    out = {}
    for field in batches.schema:
        if field.name in expected:
            want, got = expected[field.name], dtype_kind(field.dataType)
            out[field.name] = (want, got, want == "numeric" and got == "text")
    return out


def _mismatch(kinds: dict[str, tuple[str, str, bool]] | str, unparsable: Column) -> Column:
    if kinds == BY_CONTENT:
        return unparsable > 0
    by_content = [f for f, (_, _, content) in kinds.items() if content]
    fixed = [f for f, (want, got, content) in kinds.items() if want != got and not content]
    never = F.lit(False)
    return F.when(F.col("feature").isin(fixed) if fixed else never, F.lit(True)).when(
        F.col("feature").isin(by_content) if by_content else never, unparsable > 0).otherwise(never)


def type_mismatches(columns: DataFrame, kinds: dict[str, tuple[str, str, bool]]) -> DataFrame:
    """The mismatching (batch, feature) rows with expected and actual kind."""
    want = F.create_map(*[x for f, (w, _, _) in kinds.items() for x in (F.lit(f), F.lit(w))])
    got = F.create_map(*[x for f, (_, g, _) in kinds.items() for x in (F.lit(f), F.lit(g))])
    return columns.filter("type_mismatch").withColumn("expected", want[F.col("feature")]).withColumn(
        "actual", got[F.col("feature")])


def numeric_quality(state: DataFrame, keys: list[str],
                    kinds: dict[str, tuple[str, str, bool]] | str | None = None) -> DataFrame:
    """Per-column report of numeric features, from the numeric batch state."""
    return state.select(
        *keys, "feature", F.lit(S.NUMERIC).alias("type"), "rows", "missing",
        pct(F.col("missing"), F.col("rows")).alias("missing_pct"),
        _mismatch(kinds or {}, F.col("unparsable")).alias("type_mismatch"),
        F.col("n").alias("numeric_values"), "below_min", "above_max",
        (F.col("below_min") + F.col("above_max")).alias("out_of_range"),
        pct(F.col("below_min") + F.col("above_max"), F.col("n")).alias("out_of_range_pct"),
        "outliers", pct(F.col("outliers"), F.col("n")).alias("outlier_pct"),
        F.lit(0).cast("long").alias("unseen"))


def categorical_quality(state: DataFrame, base: CategoryBaseline, keys: list[str],
                        kinds: dict[str, tuple[str, str, bool]] | str | None = None) -> DataFrame:
    """Per-column report of categorical features, from the category batch state."""
    sizes = category_sizes(state, keys)
    unseen = unseen_categories(
        state.filter(F.col("category").isNotNull()), base, keys
    ).groupBy(*keys, "feature").agg(F.count("*").alias("unseen"))
    zero = F.lit(0).cast("long")
    return sizes.join(unseen, [*keys, "feature"], "left").select(
        *keys, "feature", F.lit(S.CATEGORICAL).alias("type"), "rows", "missing",
        pct(F.col("missing"), F.col("rows")).alias("missing_pct"),
        _mismatch(kinds or {}, zero).alias("type_mismatch"),
        zero.alias("numeric_values"), zero.alias("below_min"), zero.alias("above_max"),
        zero.alias("out_of_range"), F.lit(0.0).alias("out_of_range_pct"), zero.alias("outliers"),
        F.lit(0.0).alias("outlier_pct"), F.coalesce("unseen", F.lit(0)).alias("unseen"))


def no_columns(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The per-column report of batches that have none of the features: no rows."""
    zero = F.lit(0).cast("long")
    counts = ["numeric_values", "below_min", "above_max", "out_of_range", "outliers", "unseen"]
    return batches.limit(0).select(
        *keys, F.lit("").alias("feature"), F.lit("").alias("type"), zero.alias("rows"), zero.alias("missing"),
        F.lit(0.0).alias("missing_pct"), F.lit(False).alias("type_mismatch"), *[zero.alias(c) for c in counts],
        F.lit(0.0).alias("out_of_range_pct"), F.lit(0.0).alias("outlier_pct"))


def quality_report(columns: DataFrame, duplicates: DataFrame, keys: list[str],
                   weights: dict | None = None) -> DataFrame:
    """One row per batch: rates, five capped penalties and the 0-100 score."""
    w = {**S.QUALITY_WEIGHTS, **(weights or {})}
    per = columns.groupBy(*keys).agg(
        F.count("*").alias("columns_checked"), F.sum("missing").alias("missing_total"),
        F.sum("rows").alias("_cells"), F.sum("numeric_values").alias("_numeric"),
        F.sum("outliers").alias("outlier_total"),
        F.count_if("type_mismatch").alias("mismatch_columns"),
        F.count_if(F.col("unseen") > 0).alias("unseen_columns"))
    # a batch without any of the checked columns is still reported
    report = duplicates.join(per, keys, "left").fillna(0, [c for c in per.columns if c not in keys]).withColumn(
        "missing_pct", pct(F.col("missing_total"), F.col("_cells"))).withColumn(
        "outlier_pct", pct(F.col("outlier_total"), F.col("_numeric")))

    def capped(cap: str, value: Column) -> Column:
        return F.least(F.lit(w[cap]), value)

    penalties = {
        "penalty_missing": capped("missing_cap", F.col("missing_pct") * w["missing_rate"]),
        "penalty_duplicates": capped("duplicate_cap", F.col("duplicate_pct") * w["duplicate_rate"]),
        "penalty_type_mismatches": capped(
            "type_mismatch_cap", F.col("mismatch_columns") * w["type_mismatch_per_column"]),
        "penalty_unseen_categories": capped(
            "unseen_category_cap", F.col("unseen_columns") * w["unseen_category_per_column"]),
        "penalty_outliers": capped("outlier_cap", F.col("outlier_pct") * w["outlier_rate"]),
    }
    total = sum(penalties.values(), F.lit(0.0))
    return report.select(
        *keys, "row_count", "columns_checked", "missing_total", "missing_pct", "duplicate_rows",
        "duplicate_pct", "mismatch_columns", "unseen_columns", "outlier_total", "outlier_pct",
        *[F.bround(c, 4).alias(name) for name, c in penalties.items()],
        half_even(F.greatest(F.lit(0.0), 100.0 - total)).alias("quality_score"))


def problem_columns(columns: DataFrame) -> DataFrame:
    """Columns with any finding, with a readable list of findings."""
    unseen = F.concat(F.col("unseen").cast("string"), F.lit(" unseen categor"),
                      F.when(F.col("unseen") == 1, "y").otherwise("ies"))
    issues = F.array_compact(F.array(
        F.when(F.col("missing_pct") > 0, "missing values"),
        F.when(F.col("unseen") > 0, unseen),
        F.when(F.col("type_mismatch"), "type mismatch"),
        F.when(F.col("out_of_range") > 0, "out of range")))
    return columns.withColumn("issues", issues).filter(F.size("issues") > 0)
