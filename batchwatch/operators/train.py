"""Training a classifier on a table and turning it into a monitored version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    Imputer,
    IndexToString,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.values import as_category, as_number
from . import performance as P
from ..storage import materialise
from .sampling import stratified_split

MIN_TRAINING_ROWS = 100
_LABEL, _WEIGHT, _PREDICTION = "_label", "_weight", "prediction_label"

# The offered algorithms and their settings.
ALGORITHMS = {
    "logistic_regression": lambda: LogisticRegression(maxIter=1000),
    "decision_tree": lambda: DecisionTreeClassifier(maxDepth=8, minInstancesPerNode=15, seed=S.SEED),
    "random_forest": lambda: RandomForestClassifier(
        numTrees=200, maxDepth=10, minInstancesPerNode=10, seed=S.SEED),
    "balanced_random_forest": lambda: RandomForestClassifier(
        numTrees=200, maxDepth=10, minInstancesPerNode=10, seed=S.SEED),
    "balanced_gradient_boosting": lambda: GBTClassifier(seed=S.SEED),
}


@dataclass
class Trained:
    model: PipelineModel
    metrics: DataFrame
    train: DataFrame
    test: DataFrame
    features: list[str]


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """n / (classes * n_class) per class."""
    per = df.groupBy(target).agg(F.count("*").alias("c"))
    total = per.agg(F.sum("c").alias("n"), F.count("*").alias("k")).first()
    return per.select(target, (F.lit(total["n"]) / (F.lit(total["k"]) * F.col("c"))).alias(_WEIGHT))


def preprocessing(numeric: list[str], categorical: list[str]) -> list:
    """Standardised numerics beside one-hot categoricals; unseen categories encode as zeros."""
    stages, parts = [], []
    if numeric:
        filled = [f"_num_{c}" for c in numeric]
        stages += [
            Imputer(inputCols=numeric, outputCols=filled, strategy="mean"),
            VectorAssembler(inputCols=filled, outputCol="_num"),
            StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True)]
        parts.append("_scaled")
    if categorical:
        index, hot = [f"_idx_{c}" for c in categorical], [f"_hot_{c}" for c in categorical]
        stages += [
            StringIndexer(inputCols=categorical, outputCols=index, handleInvalid="keep"),
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True)]
        parts += hot
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def prepared(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Model inputs in the types the pipeline expects; every other column stays as it is."""
    types = {f.name: f.dataType for f in df.schema}
    return df.select(*[
        as_number(c, types[c]).alias(c) if c in numeric
        else as_category(c, types[c]).alias(c) if c in categorical else F.col(f"`{c}`")
        for c in df.columns])


def fit_classifier(train: DataFrame, target: str, numeric: list[str], categorical: list[str],
                   algorithm: str) -> PipelineModel:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    labels = StringIndexer(inputCol=target, outputCol=_LABEL, stringOrderType="alphabetAsc",
                           handleInvalid="skip").fit(train)
    estimator = ALGORITHMS[algorithm]().setLabelCol(_LABEL).setFeaturesCol("features")
    data = prepared(train, numeric, categorical)
    if algorithm.startswith("balanced"):
        data = data.join(class_weights(train, target), target)
        estimator = estimator.setWeightCol(_WEIGHT)
    stages = [*preprocessing(numeric, categorical), estimator]
    fitted = Pipeline(stages=stages).fit(labels.transform(data))
    back = IndexToString(inputCol="prediction", outputCol=_PREDICTION, labels=labels.labels)
    return PipelineModel([*fitted.stages, back])


def score_with_model(model: PipelineModel, df: DataFrame, numeric: list[str],
                     categorical: list[str]) -> DataFrame:
    """Adds ``prediction_label``; absent input columns are an error."""
    absent = [c for c in [*numeric, *categorical] if c not in df.columns]
    if absent:
        raise ValueError(f"batch lacks required feature columns: {absent}")
    scored = model.transform(prepared(df, numeric, categorical))
    return scored.select(*df.columns, _PREDICTION)


def score_with_rule(df: DataFrame, rule: Column) -> DataFrame:
    return df.withColumn(_PREDICTION, rule)


def score_with_function(df: DataFrame, features: list[str], predict) -> DataFrame:
    """Any Python model: ``predict`` maps a pandas frame of the features to labels, per Arrow batch.

    A result of another length than its input fails the job, as does an error in the model.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(_PREDICTION, T.StringType())])

    def run(frames):
        for frame in frames:
            labels = list(predict(frame[features]))
            if len(labels) != len(frame):
                raise ValueError(f"model returned {len(labels)} predictions for {len(frame)} rows")
            yield frame.assign(**{_PREDICTION: [str(x) for x in labels]})

    return df.mapInPandas(run, schema)


def score_isolated(df: DataFrame, keys: list[str], features: list[str], predict) -> tuple[DataFrame, DataFrame]:
    """(scored rows, failures): like ``score_with_function``, but an error fails its batch and no other.

    The model sees the rows of one batch at a time. A batch with an error in any of its parts is in failures (keys,
    row_count, message of the first error by text) and has no scored rows. Rows and errors are written in one pass.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(_PREDICTION, T.StringType()), T.StructField("_error", T.StringType())])

    def judged(part):
        try:
            labels = list(predict(part[features]))
            if len(labels) != len(part):
                raise ValueError(f"model returned {len(labels)} predictions for {len(part)} rows")
        except Exception as error:  # whatever a model raises is the batch's result
            return part.assign(**{_PREDICTION: None, "_error": f"{type(error).__name__}: {error}"})
        return part.assign(**{_PREDICTION: [str(x) for x in labels], "_error": None})

    def run(frames):
        for frame in frames:
            for _, part in frame.groupby(keys, sort=False, dropna=False):
                yield judged(part)

    stored = materialise(df.mapInPandas(run, schema), "scored")
    sizes = stored.groupBy(*keys).agg(F.count("*").alias("row_count"), F.min("_error").alias("message"))
    failures = materialise(sizes.where("message IS NOT NULL"), "failures")
    return stored.join(failures.select(*keys), keys, "left_anti").drop("_error"), failures


def failed_runs(failures: DataFrame, keys: list[str]) -> DataFrame:
    """A FAILED run for every batch whose scoring failed; readers see it beside the runs of the others."""
    return failures.select(*keys, F.lit(S.FAILED).alias("status"), "row_count", "message")


def holdout_metrics(scored: DataFrame, target: str, positive: str | None = None) -> DataFrame:
    """One row: accuracy, precision, recall, F1; of the positive class if binary, else macro.

    Macro values average over the labels seen on either side, however many there are; a class without
    predictions has precision 0, one without true rows recall 0. Rows without a true label do not count.
    """
    counts = P.outcome_counts(scored.withColumn("_all", F.lit(0)), ["_all"], target, _PREDICTION).filter(
        "y_true IS NOT NULL")
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    per = sides.filter("label IS NOT NULL").groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    ratio = {"precision": ("hit", "predicted"), "recall": ("hit", "support")}
    scores = per.withColumns({k: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) for k, (a, b) in ratio.items()})
    scores = scores.withColumn("f1", F.coalesce(F.try_divide(
        2 * F.col("hit"), F.col("predicted") + F.col("support")), F.lit(0.0)))
    is_positive = F.lit(False) if positive is None else F.col("label") == positive
    names = ("precision", "recall", "f1")
    totals = scores.agg(
        F.count_if(F.col("support") > 0).alias("_true"), F.count_if(is_positive & (F.col("support") > 0)).alias("_known"),
        F.sum("support").alias("sample_count"), F.try_divide(F.sum("hit"), F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(m) for m in names], *[F.max(F.when(is_positive, F.col(m))).alias(f"_{m}") for m in names])
    binary = (F.col("_true") == 2) & (F.col("_known") == 1)
    return totals.select(
        "accuracy", *[F.when(binary, F.col(f"_{m}")).otherwise(F.col(m)).alias(m) for m in names],
        F.when(binary, "positive class").otherwise("macro").alias("averaging"), "sample_count")


def train_classifier(df: DataFrame, target: str, numeric: list[str], categorical: list[str],
                     row_key: list[str], algorithm: str, positive: str | None = None,
                     test_share: float = 0.25) -> Trained:
    """Check, split by class, fit and evaluate. The training split is the version's baseline."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the table")
    per = df.groupBy(target).agg(F.count("*").alias("c"))
    facts = per.agg(F.sum("c").alias("rows"), F.count(target).alias("classes")).first()
    if (facts["rows"] or 0) < MIN_TRAINING_ROWS:
        raise ValueError(f"training needs at least {MIN_TRAINING_ROWS} rows")
    if facts["classes"] < 2:
        raise ValueError(f"{target!r} has fewer than two distinct values")
    if not numeric and not categorical:
        raise ValueError("no usable feature columns")
    labelled = df.filter(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("string"))
    split = stratified_split(labelled, target, row_key, test_share)
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    model = fit_classifier(train, target, numeric, categorical, algorithm)
    scored = score_with_model(model, test, numeric, categorical)
    return Trained(model, holdout_metrics(scored, target, positive), train, test,
                   [*numeric, *categorical])


def baseline_prediction_mix(scored_baseline: DataFrame) -> DataFrame:
    """Class counts and shares of a version's predictions on its baseline."""
    per = scored_baseline.groupBy(F.col(_PREDICTION).alias("y_pred")).agg(F.count("*").alias("n"))
    total = scored_baseline.count()
    return per.select("y_pred", "n", (F.col("n") / F.lit(total)).alias("share"))
