"""Reading baselines, batches and raw multi-file drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

_FORMATS = {".csv": "csv", ".parquet": "parquet"}


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str | None = None) -> DataFrame:
    """A header CSV or a Parquet table. Unreadable and empty inputs are errors.

    The format follows the file name unless given. Pass a schema for CSV where it is known: it
    saves the inference pass.
    """
    kind = fmt or next((f for end, f in _FORMATS.items() if path.rstrip("/*").endswith(end)), None)
    if kind not in _FORMATS.values():
        raise ValueError(f"not a readable table: {path}")
    reader = spark.read
    if kind == "csv":
        reader = reader.option("header", True)
        frame = (reader.schema(schema).csv(path) if schema is not None
                 else reader.option("inferSchema", True).csv(path))
    else:
        frame = (reader.schema(schema) if schema is not None else reader).parquet(path)
    if frame.isEmpty():
        raise ValueError(f"the table holds no rows: {path}")
    return frame


def baseline_check(df: DataFrame, target: str, min_rows: int = S.MIN_BASELINE_ROWS) -> DataFrame:
    """Row count, target classes and every reason to refuse the table as a baseline."""
    if target not in df.columns:
        facts = df.agg(F.count("*").alias("row_count")).withColumn(
            "target_values", F.lit(None).cast("long"))
        reasons = [F.lit(f"target column '{target}' is not in the table")]
    else:
        # two-level count: a distinct aggregate without a per-row expansion
        per = df.groupBy(target).agg(F.count("*").alias("c"))
        facts = per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("row_count"),
                        F.count(target).alias("target_values"))
        reasons = [F.when(F.col("row_count") < min_rows, f"fewer than {min_rows} rows"),
                   F.when(F.col("target_values") < 2, "target has fewer than two distinct values")]
    found = F.array_join(F.array_compact(F.array(*reasons)), "; ")
    return facts.select("row_count", "target_values", (found == "").alias("accepted"),
                        found.alias("reasons"))


def load_reference(spark: SparkSession, sample_path: str | None, source_path: str) -> DataFrame:
    """The stored reference sample; the source table where none was stored."""
    if sample_path:
        try:
            return read_table(spark, sample_path, fmt="parquet")
        except Exception as exc:  # a missing path surfaces as an analysis error
            if "PATH_NOT_FOUND" not in str(exc):
                raise
    return read_table(spark, source_path)


def read_raw_parts(spark: SparkSession, parts: list[tuple[str, bool]], columns: list[str]) -> DataFrame:
    """Headerless CSV files with given column names; ``?`` is missing, blanks are trimmed.

    ``parts`` holds (path, first line is a comment). Comment lines start with ``|``.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    frames = []
    for path, commented in parts:
        reader = (spark.read.schema(schema).option("ignoreLeadingWhiteSpace", True)
                  .option("ignoreTrailingWhiteSpace", True).option("nullValue", "?"))
        frames.append((reader.option("comment", "|") if commented else reader).csv(path))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def clean_parts(raw: DataFrame, drop: list[str], label: str) -> DataFrame:
    """Drop columns, strip trailing dots and blanks off the label, drop incomplete rows."""
    kept = raw.drop(*drop)
    return kept.withColumn(label, F.trim(F.regexp_replace(F.col(label), r"\.+$", ""))).na.drop("any")


def coerce_numbers(df: DataFrame, column: str) -> DataFrame:
    """Text to number; what does not parse becomes 0.0 and is flagged in ``<column>_blank``."""
    number = _parsed(column)
    return df.withColumn(f"{column}_blank", number.isNull()).withColumn(
        column, F.coalesce(number, F.lit(0.0)))


def _parsed(column: str) -> Column:
    c = F.col(column).cast("string").try_cast("double")
    return F.when(~F.isnan(c), c)


def fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and digest of a table's content: the sum of one hash per row, so row order and file layout do not matter.

    Values are joined with their separator escaped and nulls marked, so different rows have different texts.
    """
    def marked(name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        return F.coalesce(F.replace(F.replace(text, F.lit("!"), F.lit("!!")), F.lit("|"), F.lit("!/")), F.lit("!-"))

    row = F.md5(F.concat_ws("|", *[marked(c) for c in df.columns]))
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(number).cast("string").alias("digest"))


def trigger_source(source: Column) -> Column:
    """Which trigger a batch source maps to."""
    return (F.when(source == "UPLOAD", "UPLOAD").when(source == "SIMULATOR", "SCHEDULED")
            .when(source == "API", "API").otherwise("MANUAL"))


def ingest_batches(rows: DataFrame, keys: list[str], source: Column, target: str | None,
                   received: Column) -> DataFrame:
    """One batch record per batch key: rows, labels, source, trigger, time received."""
    has_labels = F.max(F.col(target).isNotNull()) if target and target in rows.columns else F.lit(False)
    return rows.withColumn("_source", source).groupBy(*keys).agg(
        F.count("*").alias("row_count"), has_labels.alias("has_labels"),
        F.max("_source").alias("source"), F.max(received).alias("received_at"),
    ).withColumn("trigger_source", trigger_source(F.col("source")))
