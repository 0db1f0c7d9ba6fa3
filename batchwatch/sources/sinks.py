"""Writing monitoring results so that readers see whole runs only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHILD_TABLES = ("feature_results", "feature_summaries", "unseen_values", "quality_reports", "quality_columns",
                "performance", "mix", "confusion")


def persist_runs(tables: dict[str, DataFrame], root: str, commit_id: str) -> None:
    """Write child tables first and ``runs`` last: a run exists once its row does.

    Every commit owns a folder ``commit=<id>`` below each table, so a repeated commit after a lost
    job overwrites its own files and nothing else.
    """
    for name in (*[t for t in CHILD_TABLES if t in tables], "runs"):
        tables[name].write.mode("overwrite").parquet(f"{root}/{name}/commit={commit_id}")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/runs")


def read_children(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Child rows of committed runs only."""
    commits = read_runs(spark, root).select(F.col("commit").cast("string").alias("commit")).distinct()
    rows = spark.read.parquet(f"{root}/{name}").withColumn("commit", F.col("commit").cast("string"))
    return rows.join(commits, "commit", "left_semi")


def write_history_csv(export: DataFrame, path: str, order: str = "Timestamp") -> None:
    """Newest first, range-sorted across files; nothing is gathered in one task."""
    export.orderBy(F.desc(order), F.desc("Run ID")).write.mode("overwrite").option(
        "header", True).csv(path)


def write_reference_sample(sample: DataFrame, path: str) -> None:
    sample.write.mode("overwrite").parquet(path)


def write_splits(split: DataFrame, root: str, column: str = "split") -> None:
    """One folder per split in a single pass."""
    split.write.mode("overwrite").partitionBy(column).parquet(root)
