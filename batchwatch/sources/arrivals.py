"""Wide batches as files: which ones lack required columns, told from their schemas alone.

The column names of every file come from its footer or its header line, read by tasks; no row is read before the
verdict. Accepted files are then read together, rejected ones become REJECTED batch rows.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.history import rejection_message
from ..storage import materialise

#: bytes read at a time in search of the end of a header line
_HEADER_BYTES = 65_536


def _names(path: str) -> list[str]:
    """Column names of a parquet or delimited file."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if inner.lower().endswith(".parquet"):
        with store.open_input_file(inner) as file:
            return pq.read_schema(file).names
    head = b""
    with store.open_input_stream(inner) as file:
        while b"\n" not in head and (more := file.read(_HEADER_BYTES)):
            head += more
    line = head.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")
    return next(csv.reader(io.StringIO(line)), [])


def arriving_columns(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, columns, error of every file below ``folder`` whose name fits ``pattern``; unreadable files have an error.

    The driver lists names, as any reader of a folder does; files are opened by tasks. Names beginning with ``_`` or
    ``.`` are not data.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    prefix = folder[:len(folder) - len(base)] if folder.endswith(base) else ""
    names = [info.path for info in store.get_file_info(fs.FileSelector(base, recursive=True)) if info.is_file]
    found = [(prefix + n,) for n in names if fnmatch(n.rsplit("/", 1)[-1], pattern) and n.rsplit("/", 1)[-1][:1] not in "_."]
    paths = spark.createDataFrame(found, "path string")
    paths = paths.repartition(max(1, min(len(found), spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    rows.append((path, _names(path), None))
                except Exception as error:  # a broken file is rejected, the others go on
                    rows.append((path, [], f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "columns", "error"])

    return paths.mapInPandas(run, "path string, columns array<string>, error string")


def judge_files(arrived: DataFrame, required: DataFrame, refusals: DataFrame | None = None) -> DataFrame:
    """path, columns, missing, status (RECEIVED or REJECTED), message.

    ``arrived`` has path, columns, error and, with several models, model_id; ``required`` has feature, and model_id if
    ``arrived`` has it. ``missing`` holds all missing names in order; the message shows eight. ``refusals`` (model_id,
    refusal_reason) of the preflight reject every file of a model. A file without any required list is received.
    """
    on = ["model_id"] if "model_id" in arrived.columns else []
    # one row per monitored column of a table
    wanted = required.groupBy(*on).agg(F.array_sort(F.collect_set("feature")).alias("_wanted"))
    told = arrived.join(wanted, on, "left") if on else arrived.join(F.broadcast(wanted), how="left")
    told = told.withColumn("missing", F.when(F.col("error").isNull(), F.array_except(
        F.coalesce("_wanted", F.array().cast("array<string>")), "columns")).otherwise(F.array().cast("array<string>")))
    refused = F.lit(None).cast("string")
    if refusals is not None:
        told = told.join(refusals.where("refusal_reason IS NOT NULL"), on, "left")
        refused = F.col("refusal_reason")
    message = F.coalesce(refused, F.concat(F.lit("File cannot be read: "), "error"),
                         F.when(F.size("missing") > 0, rejection_message(F.col("missing"))))
    return told.select(*on, "path", "columns", "missing",
                       F.when(message.isNull(), "RECEIVED").otherwise(S.REJECTED).alias("status"), message.alias("message"))


def read_accepted(spark: SparkSession, verdicts: DataFrame, kind: str = "parquet") -> DataFrame | None:
    """The rows of the received files with their ``path``; columns some files lack are null there. None without files.

    ``verdicts`` should be stored. Only the paths of one folder's received files are listed for the reader.
    """
    paths = [r.path for r in verdicts.where("status = 'RECEIVED'").select("path").toLocalIterator()]
    if not paths:
        return None
    reader = spark.read.option("mergeSchema", True) if kind == "parquet" else spark.read.option("header", True)
    return reader.format(kind).load(paths).withColumn("path", F.col("_metadata.file_path"))


def admit_files(spark: SparkSession, folder: str, required: DataFrame, kind: str = "parquet",
                refusals: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(rows of the received files, stored verdicts of all files)."""
    arrived = arriving_columns(spark, folder, f"*.{kind}")
    verdicts = materialise(judge_files(arrived, required, refusals), "verdicts")
    return read_accepted(spark, verdicts, kind), verdicts
