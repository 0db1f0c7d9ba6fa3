"""Wide tables to (batch, feature, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import as_category, as_number, dtype_kind


def _melt(df: DataFrame, keys: list[str], columns: dict, value: str) -> DataFrame:
    prepared = df.select(*keys, *[c.alias(name) for name, c in columns.items()])
    return prepared.unpivot(
        keys, [F.col(f"`{name}`") for name in columns], "feature", value)


def numeric_long(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """keys, feature, value double (null = missing or unparsable), present boolean.

    While long, an unparsable value travels as NaN, so a row carries one double and no struct.
    """
    types = {f.name: f.dataType for f in df.schema}
    columns = {f: _marked_number(f, types[f]) for f in features if f in types}
    raw = F.col("_raw")
    return _melt(df, keys, columns, "_raw").select(
        *keys, "feature", F.when(~F.isnan(raw), raw).alias("value"), raw.isNotNull().alias("present"))


def category_long(df: DataFrame, features: list[str], keys: list[str],
                  declared: dict[str, str] | None = None) -> DataFrame:
    """keys, feature, category string (null = missing)."""
    types = {f.name: f.dataType for f in df.schema}
    columns = {f: as_category(f, types[f], (declared or {}).get(f))
               for f in features if f in types}
    return _melt(df, keys, columns, "category")


def _marked_number(name: str, dtype: T.DataType) -> Column:
    """The column as double; null where it is missing, NaN where it is text that does not parse."""
    number = as_number(name, dtype)
    if dtype_kind(dtype) != "text":
        return number
    return F.when(F.col(f"`{name}`").isNotNull(), F.coalesce(number, F.lit(float("nan"))))
