"""Column classification, exclusion hints and the baseline schema table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import FRACTIONAL, INTEGRAL, TEMPORAL, dtype_kind
from ..schemas import CATEGORICAL, ID_NAME_PATTERN, MAX_DISTINCT_CATEGORICAL, NUMERIC

# Fixed texts: stored with the schema and shown to users.
REASON_TIMESTAMP = "Timestamp column — drift on a timestamp is not meaningful"
REASON_EMPTY = "Column is entirely empty"
REASON_CONSTANT = "Constant column — one distinct value, so it cannot drift"
REASON_IDENTIFIER = "Appears to be an identifier — one distinct value per row"
REASON_NAME = "Column name looks like an identifier"


def column_cardinalities(df: DataFrame) -> DataFrame:
    """column_name, position, non_null, distinct for every column.

    Distinct values are counted by grouping (column, digest of the value): the work is spread over all
    values and pre-aggregated before the shuffle, and long texts travel as 16 bytes.
    """
    struct = F.struct
    cells = []
    for position, field in enumerate(df.schema):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c + F.lit(0.0))
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        cells.append(struct(
            F.lit(position).alias("position"), F.lit(field.name).alias("column_name"),
            F.unhex(F.md5(c.cast("string").cast("binary"))).alias("value")))
    values = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    groups = values.groupBy("position", "column_name", "value").agg(F.count("*").alias("n"))
    return groups.groupBy("position", "column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count_if(F.col("value").isNotNull()).alias("distinct_values"))


def _dtype_table(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString(), dtype_kind(f.dataType),
             isinstance(f.dataType, TEMPORAL), isinstance(f.dataType, FRACTIONAL),
             isinstance(f.dataType, INTEGRAL + FRACTIONAL))
            for i, f in enumerate(df.schema)]
    return spark.createDataFrame(
        rows, "position int, column_name string, dtype string, kind string, is_temporal boolean,"
              " is_fractional boolean, is_numeric boolean")


def dtype_kinds(df: DataFrame) -> DataFrame:
    return _dtype_table(df).select("column_name", "kind")


def classified_columns(df: DataFrame) -> DataFrame:
    """One row per column: cardinalities, NUMERIC or CATEGORICAL, first exclusion reason."""
    stats = column_cardinalities(df).join(F.broadcast(_dtype_table(df)), ["position", "column_name"], "right")
    non_null = F.coalesce("non_null", F.lit(0))
    distinct = F.coalesce("distinct_values", F.lit(0))
    reason = (
        F.when(F.col("is_temporal"), REASON_TIMESTAMP)
        .when(non_null == 0, REASON_EMPTY)
        .when(distinct == 1, REASON_CONSTANT)
        .when((distinct >= 0.99 * non_null) & ~F.col("is_fractional"), REASON_IDENTIFIER)
        .when(F.col("column_name").rlike(ID_NAME_PATTERN), REASON_NAME))
    return stats.select(
        "position", "column_name", "dtype", "kind", non_null.alias("non_null"),
        distinct.alias("distinct_values"),
        F.when(F.col("is_numeric") & (distinct > MAX_DISTINCT_CATEGORICAL), NUMERIC)
        .otherwise(CATEGORICAL).alias("type"),
        reason.alias("exclusion_reason"))


def infer_schema(df: DataFrame, target: str | None) -> DataFrame:
    """The baseline schema: one row per column, in column order."""
    if target is not None and target not in df.columns:
        raise ValueError(
            f"target column {target!r} is not present; columns: {', '.join(df.columns)}")
    is_target = F.col("column_name") == F.lit(target) if target else F.lit(False)
    reason = F.when(~is_target, F.col("exclusion_reason"))
    return classified_columns(df).select(
        F.col("position").cast("long").alias("position"), "column_name", "dtype", "type",
        is_target.alias("is_target"),
        (~is_target & reason.isNull()).alias("is_feature"),
        reason.isNotNull().alias("excluded"),
        reason.alias("exclusion_reason"))


def apply_overrides(schema: DataFrame, overrides: DataFrame) -> DataFrame:
    """User choices (column_name, type, is_feature, excluded) over the inferred schema.

    Null means "as inferred"; overrides for unknown columns are ignored.
    """
    o = overrides.select("column_name", *[
        F.col(c).alias(f"_{c}") for c in ("type", "is_feature", "excluded")])
    return schema.join(F.broadcast(o), "column_name", "left").select(
        "position", "column_name", "dtype",
        F.coalesce("_type", "type").alias("type"), "is_target",
        F.coalesce("_is_feature", "is_feature").alias("is_feature"),
        F.coalesce("_excluded", "excluded").alias("excluded"), "exclusion_reason")


def feature_columns(schema: DataFrame, feature_type: str | None = None) -> list[str]:
    """Names of the monitored columns in schema order (as many as the table is wide)."""
    kept = schema.filter("is_feature")
    if feature_type:
        kept = kept.filter(F.col("type") == feature_type)
    return [r[0] for r in kept.orderBy("position").select("column_name").collect()]


def target_column(schema: DataFrame) -> str | None:
    row = schema.filter("is_target").select("column_name").first()
    return row[0] if row else None


def require_columns(df: DataFrame, features: list[str]) -> DataFrame:
    """Explicit, ordered selection of the model's inputs; absent ones are an error."""
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise ValueError(f"batch lacks required feature columns: {absent}")
    return df.select(*features)
