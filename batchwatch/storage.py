"""Where jobs put what must survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    A folder of our own is chosen only where nothing is configured, which is the
    case in local tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="batchwatch-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, cutting the lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_copy(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A small table as a local relation, whose size Spark knows and which it joins by broadcast.

    A table of more than ``most`` rows is stored instead and joined as Spark sees fit.
    """
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return materialise(df, "large")
    return df.sparkSession.createDataFrame(rows)


def near(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A stored or local table with a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
