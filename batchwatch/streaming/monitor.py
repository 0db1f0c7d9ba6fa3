"""Monitoring a stream of batches and of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import divergence as D
from ..functions.values import pct
from ..operators.history import missing_required
from ..operators.longform import numeric_long
from ..operators.ordered import newest
from ..operators.profile import bin_array, bin_count_columns, bin_index
from ..operators.retrain import consecutive_below
from ..plans.monitor import Baseline, run_monitoring
from ..sources.sinks import persist_runs
from .sources import drain_batches


def stream_monitor(stream: DataFrame, baseline: Baseline, keys: list[str], prediction: Column,
                   root: str, checkpoint: str, **options) -> None:
    """Every micro-batch of complete batches runs the whole monitoring and appends its results.

    Results of a micro-batch live under its epoch, so a replay after a failure overwrites them.
    """
    def handle(frame: DataFrame, epoch: int) -> None:
        if frame.isEmpty():
            return
        result = run_monitoring(frame, baseline, keys, prediction, **options)
        persist_runs(result.tables(), root, str(epoch))

    drain_batches(stream, handle, checkpoint)


def windowed_state(stream: DataFrame, profile: DataFrame, features: list[str], ts: str,
                   watermark: str, width: str, slide: str | None = None) -> DataFrame:
    """Event-time windows of baseline-binned counts and quality counts; a window is a batch.

    The profile is static, with one row per feature column, and joins by broadcast. State per
    window and feature is one row.
    """
    spread = F.col("q3") - F.col("q1")
    base = F.broadcast(profile.select(
        "feature", "bin_edges", F.col("min").alias("base_min"), F.col("max").alias("base_max"),
        (F.col("q1") - S.OUTLIER_FENCE * spread).alias("lower_fence"),
        (F.col("q3") + S.OUTLIER_FENCE * spread).alias("upper_fence")))
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    window = F.window("_ts", width, slide) if slide else F.window("_ts", width)
    long = numeric_long(timed, features, ["_ts"])
    v = F.col("value")
    counted = long.join(base, "feature").withColumn("_bin", bin_index("value", "bin_edges")).groupBy(window.alias("w"), "feature").agg(
        F.count("*").alias("rows"), F.count(v).alias("n"),
        F.count_if(v < F.col("base_min")).alias("below_min"),
        F.count_if(v > F.col("base_max")).alias("above_max"),
        F.count_if((v < F.col("lower_fence")) | (v > F.col("upper_fence"))).alias("outliers"),
        *bin_count_columns())
    edges = F.broadcast(profile.select("feature", "bin_edges", F.col("bin_counts").alias("base_counts")))
    return counted.join(edges, "feature").select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feature",
        "rows", "n", "below_min", "above_max", "outliers",
        bin_array("bin_edges").alias("bin_counts"), "base_counts")


def windowed_drift(state: DataFrame) -> DataFrame:
    """PSI and JSD per closed window."""
    return state.select(
        "window_start", "feature", "n",
        D.psi("base_counts", "bin_counts").alias("psi"),
        D.jsd("base_counts", "bin_counts").alias("jsd"))


def windowed_quality(state: DataFrame) -> DataFrame:
    """Missing, range and outlier counts per closed window."""
    missing = F.col("rows") - F.col("n")
    return state.select(
        "window_start", "feature", "rows", missing.alias("missing"),
        pct(missing, F.col("rows")).alias("missing_pct"), "below_min", "above_max", "outliers",
        pct(F.col("outliers"), F.col("n")).alias("outlier_pct"))


def stream_alert_dedup(occurrences: DataFrame, keys: list[str], ts: str, tie: str, watermark: str,
                       cooldown: str = "60 minutes") -> DataFrame:
    """Occurrences at most one cooldown apart merge; an alert is emitted once no more can join."""
    timed = occurrences.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    grouped = timed.groupBy(*keys, F.session_window("_ts", cooldown).alias("s")).agg(
        F.count("*").alias("occurrence_count"), F.min("_ts").alias("first_seen_at"),
        F.max("_ts").alias("last_seen_at"), F.max_by(tie, F.struct("_ts", tie)).alias(tie))
    return grouped.drop("s")


def stream_consecutive(runs: DataFrame, score: str, limit: Column, out: str, state: str,
                       checkpoint: str) -> None:
    """Flag scored runs that, with the scored run before, are both below the limit.

    The run before may have arrived in an earlier micro-batch: the newest scored run of every
    model is carried in a small table, one version per epoch, so a replayed epoch starts from the
    same state.
    """
    columns = ["model_id", "run_id", "created_at", score]

    def handle(frame: DataFrame, epoch: int) -> None:
        spark = frame.sparkSession
        arrived = frame.filter(F.col(score).isNotNull()).select(*columns).withColumn(
            "arrived", F.lit(True))
        both = arrived
        if epoch > 0:
            carried = spark.read.schema(arrived.schema).parquet(f"{state}/epoch={epoch - 1}")
            both = arrived.unionByName(carried.withColumn("arrived", F.lit(False)))
        flagged = consecutive_below(both, score, limit, "alarm").filter("arrived").drop("arrived")
        flagged.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        newest(both, ["model_id"], ["created_at", "run_id"]).write.mode("overwrite").parquet(
            f"{state}/epoch={epoch}")

    drain_batches(runs, handle, checkpoint)


def skip_rejected(stream: DataFrame, keys: list[str], required: DataFrame, accepted: str,
                  rejected: str, checkpoint: str) -> None:
    """Long feeds: batches lacking a required feature go to the rejected table, the rest on."""
    def handle(frame: DataFrame, epoch: int) -> None:
        bad = missing_required(frame, required, keys)
        bad.write.mode("overwrite").parquet(f"{rejected}/epoch={epoch}")
        stored = frame.sparkSession.read.schema(bad.schema).parquet(f"{rejected}/epoch={epoch}")
        good = frame.join(stored.select(*keys), keys, "left_anti")
        good.write.mode("overwrite").parquet(f"{accepted}/epoch={epoch}")

    drain_batches(stream, handle, checkpoint)
