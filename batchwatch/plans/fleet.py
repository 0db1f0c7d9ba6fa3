"""Monitoring of many models in one job.

Models differ in their columns, so their rows are read in long form: (model_id, batch_id, row_id, column, value) with
the value as text. Profiles, categories and ranks are keyed by model and feature, and every model is judged by its
own thresholds, classes and reference. One plan serves any number of models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import drift as D
from ..operators.categories import category_baseline
from ..operators.profile import profile_index, stored_profile
from ..operators.quality import BY_CONTENT
from ..operators.rank_index import build_index
from ..storage import local_copy, materialise, near
from .monitor import Baseline, MonitoringResult, derive

MODEL, BATCH = "model_id", "batch_id"
KEYS = [MODEL, BATCH]
TARGET, PREDICTION = "TARGET", "PREDICTION"


def long_rows(df: DataFrame, model_id: str, batch: str, row_key: list[str], columns: list[str]) -> DataFrame:
    """A wide table as feed rows of one model. ``batch`` is an SQL expression; NaN is missing."""
    kinds = dict(df.dtypes)
    cells = [F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).cast("string") if kinds[c] in ("double", "float")
             else F.col(f"`{c}`").cast("string") for c in columns]
    wide = df.select(F.expr(batch).cast("string").alias(BATCH), F.concat_ws("|", *row_key).alias("row_id"),
                     *[cell.alias(c) for c, cell in zip(columns, cells)])
    return wide.unpivot([BATCH, "row_id"], [F.col(f"`{c}`") for c in columns], "column", "value").select(
        F.lit(model_id).alias(MODEL), BATCH, "row_id", "column", "value")


#: names up to which rows are first chosen by a filter, which Spark takes down to where the feed's cells arise
NAMES = 1000


def _named(rows: DataFrame, by: str, chosen: DataFrame) -> DataFrame:
    """Rows whose ``by`` is among those of ``chosen``; more than NAMES names leave all rows to the join that follows."""
    names = [r[0] for r in chosen.select(by).distinct().limit(NAMES + 1).collect()]
    return rows.where(F.col(by).isin(names)) if len(names) <= NAMES else rows


def _typed(rows: DataFrame, roles: DataFrame, *kinds: str) -> DataFrame:
    """Feed rows of the columns that have one of these roles, or any, with the role."""
    chosen = (roles.where(F.col("role").isin(*kinds)) if kinds else roles).select(MODEL, "column", "role")
    return _named(rows, "column", chosen).join(near(chosen), [MODEL, "column"])


def _numbers(rows: DataFrame, roles: DataFrame, keys: list[str]) -> DataFrame:
    number = F.col("value").try_cast("double")
    return _typed(rows, roles, S.NUMERIC).select(
        *keys, F.col("column").alias("feature"), F.when(~F.isnan(number), number).alias("value"),
        F.col("value").isNotNull().alias("present"))


def profile_fleet(rows: DataFrame, roles: DataFrame) -> Baseline:
    """Profiles of all models from their baseline rows (model_id, row_id, column, value).

    ``roles`` (model_id, column, role) with NUMERIC, CATEGORICAL, TARGET and PREDICTION is stored with them.
    """
    roles = local_copy(roles.select(MODEL, "column", "role").distinct())
    index = build_index(_numbers(rows, roles, [MODEL]).select(MODEL, "feature", "value"), [MODEL, "feature"])
    cells = _typed(rows, roles, S.CATEGORICAL).select(
        MODEL, F.col("column").alias("feature"), F.col("value").alias("category"))
    counts = materialise(cells.groupBy(MODEL, "feature", "category").agg(F.count("*").alias("n")), "profile-categories")
    present = F.col("category").isNotNull()
    sizes = counts.groupBy(MODEL, "feature").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"), F.count_if(present).alias("n_unique"))
    sizes = sizes.select(MODEL, "feature", "n", "missing", F.bround(
        100.0 * F.col("missing") / (F.col("n") + F.col("missing")), 4).alias("missing_pct"), "n_unique")
    return Baseline([], [], stored_profile(profile_index(index)),
                    category_baseline(counts.where("category IS NOT NULL"), [MODEL, "feature"]), index, local_copy(sizes),
                    roles=roles)


#: the columns of a row's digest
_DIGEST = ["_d0", "_d1", "_d2", "_d3"]


def row_digests(typed: DataFrame) -> DataFrame:
    """KEYS, row_id and the digest of the row's cells but its prediction, 128 bits in four sums.

    The sums, of 32 bits of every cell's SHA-256 each, do not depend on the order of the cells, and equal cells count as
    often as they occur. Buffers of fixed width keep this a hash aggregate, which combines a row's cells before the shuffle.
    """
    # the length tells where the name ends; a missing value has no second mark
    cell = F.sha2(F.concat_ws("=", F.coalesce(F.length("column"), F.lit(-1)), "column", "value"), 256)
    bits = [F.xxhash64(F.lit(i), "_cell") for i in range(2)]
    halves = [h for b in bits for h in (F.shiftrightunsigned(b, 32), b.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return typed.select(*KEYS, "row_id", F.when(F.coalesce(F.col("role") != PREDICTION, F.lit(True)), cell).alias("_cell")).groupBy(
        *KEYS, "row_id").agg(*[F.sum(F.when(F.col("_cell").isNotNull(), h)).alias(d) for d, h in zip(_DIGEST, halves)])


def _outcomes(rows: DataFrame, roles: DataFrame, sizes: DataFrame) -> DataFrame:
    """(KEYS, y_true, y_pred) -> n. Rows without a cell of either role are those that ``sizes`` has besides."""
    role, value = F.col("role"), F.col("value")
    counts = materialise(_typed(rows, roles, TARGET, PREDICTION).groupBy(*KEYS, "row_id").agg(
        F.max(F.when(role == TARGET, value)).alias("y_true"), F.max(F.when(role == PREDICTION, value)).alias("y_pred")).groupBy(
        *KEYS, "y_true", "y_pred").agg(F.count("*").alias("n")), "marked")
    null = F.lit(None).cast("string")
    rest = [part.select(*KEYS, null.alias("y_true"), null.alias("y_pred"), n.alias("n"))
            for part, n in ((sizes, F.col("row_count")), (counts, -F.col("n")))]
    return counts.unionByName(rest[0]).unionByName(rest[1]).groupBy(*KEYS, "y_true", "y_pred").agg(F.sum("n").alias("n")).where("n > 0")


def run_fleet(rows: DataFrame, baseline: Baseline, models: DataFrame, baseline_mix: DataFrame | None = None) -> MonitoringResult:
    """Monitor every batch of every model.

    ``rows`` (model_id, batch_id, row_id, column, value); a row is one row_id of a batch. ``models`` (model_id,
    thresholds struct, labels array, positive, reference_accuracy); models without an entry are not monitored. A
    feature that a batch has no cell of is reported as absent.
    """
    models = local_copy(models.select(MODEL, "thresholds", "labels", "positive", "reference_accuracy"))
    known = near(models.select(MODEL, "thresholds", "reference_accuracy"))
    roles = local_copy(baseline.roles.join(models, MODEL, "left_semi"))
    rows = _named(rows, MODEL, models).join(near(models.select(MODEL)), MODEL, "left_semi")
    # a cell leaves its row's digest only if its column is nothing but a prediction
    left_out = local_copy(roles.groupBy(MODEL, "column").agg(F.max("role").alias("role"), F.count("*").alias("_n")).where(
        (F.col("role") == PREDICTION) & (F.col("_n") == 1)).drop("_n"))
    digests = row_digests(rows.join(near(left_out), [MODEL, "column"], "left"))
    copies = digests.groupBy(*KEYS, *_DIGEST).agg(F.count("*").alias("c")).groupBy(*KEYS).agg(
        F.sum("c").alias("row_count"), (F.sum("c") - F.count("*")).alias("duplicate_rows"))
    duplicates = materialise(copies.withColumn("duplicate_pct", F.bround(
        100.0 * F.col("duplicate_rows") / F.col("row_count"), 4)), "duplicates")
    outcomes = materialise(_outcomes(rows, roles, duplicates), "outcomes")

    values = materialise(D.value_counts(_numbers(rows, roles, KEYS), KEYS), "value-counts")
    state = materialise(_typed(rows, roles, S.CATEGORICAL).groupBy(
        *KEYS, F.col("column").alias("feature"), F.col("value").alias("category")).agg(F.count("*").alias("n")), "category-state")
    features = baseline.roles.where(F.col("role").isin(S.NUMERIC, S.CATEGORICAL)).select(
        MODEL, F.col("column").alias("feature"), F.col("role").alias("feature_type"))
    there = values.select(*KEYS, "feature").unionByName(state.select(*KEYS, "feature")).distinct()
    missing = duplicates.select(*KEYS).join(features, MODEL).join(there, [*KEYS, "feature"], "left_anti")
    absent = D.absent_rows(missing, KEYS)
    limits = models.select(MODEL, "thresholds")
    return derive(values, state, duplicates, outcomes, baseline, KEYS, known, absent,
                  models.select(MODEL, F.explode("labels").alias("label")), models.select(MODEL, "positive"), baseline_mix,
                  limits, BY_CONTENT)
