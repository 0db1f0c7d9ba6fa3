"""Missing values, type kinds and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (
    T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType,
    T.YearMonthIntervalType,
)


def dtype_kind(dtype: T.DataType) -> str:
    """boolean / numeric / temporal / text: the only type distinction quality checks make."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, INTEGRAL + FRACTIONAL):
        return "numeric"
    if isinstance(dtype, TEMPORAL):
        return "temporal"
    return "text"


def as_number(name: str, dtype: T.DataType) -> Column:
    """The column as double; NaN and unparsable text become null."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, T.DoubleType):
        number = c
    elif isinstance(dtype, (T.StringType,)):
        number = c.try_cast("double")
    elif isinstance(dtype, INTEGRAL + FRACTIONAL + (T.BooleanType,)):
        return c.cast("double") if not isinstance(dtype, T.FloatType) else F.when(
            ~F.isnan(c), c.cast("double"))
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(number), number)


def as_category(name: str, dtype: T.DataType, declared: str | None = None) -> Column:
    """The column as category text, read through the baseline's declared type.

    Casting to the declared type first keeps ``0`` and ``0.0`` the same category when a
    batch arrives with a wider numeric type than the baseline had.
    """
    c = F.col(f"`{name}`")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if declared and declared != dtype.simpleString() and declared != "string":
        return c.try_cast(declared).cast("string")
    return c.cast("string")


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole to four places, 0 where the whole is empty."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, 4)).otherwise(F.lit(0.0))


def half_even(c: Column) -> Column:
    """Round half to even, as an integer score."""
    return F.bround(c, 0).cast("long")


def lit_number(text: str) -> Column:
    return F.col(text).try_cast("double")
