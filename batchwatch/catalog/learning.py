"""Training, scoring and admission of models."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import sampling as SA
from ..operators import train as T
from . import bindings as B
from .bindings import rounded

_NUMERIC, _CATEGORICAL = ["n_chars"], ["lang", "source"]


def _labelled(spark, sf):
    labels = B.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return B.table(spark, sf, "documents").select("doc_id", *_NUMERIC, *_CATEGORICAL).join(labels, "doc_id")


def _metrics(algorithm: str):
    def query(spark, sf):
        trained = T.train_classifier(
            _labelled(spark, sf), "quality", _NUMERIC, _CATEGORICAL, ["doc_id"], algorithm, "1")
        return rounded(trained.metrics.select(F.lit(algorithm).alias("algorithm"), "*"),
                       "accuracy", "precision", "recall", "f1")

    return query


def preprocess_features(spark, sf):
    from pyspark.ml import Pipeline

    data = T.prepared(B.table(spark, sf, "documents").select("doc_id", *_NUMERIC, *_CATEGORICAL),
                      _NUMERIC, _CATEGORICAL)
    model = Pipeline(stages=T.preprocessing(_NUMERIC, _CATEGORICAL)).fit(data)
    out = model.transform(data).select("doc_id", "lang", vector_to_array("features").alias("v"))
    # one scaled number, then the one-hot parts
    return out.select("doc_id", F.size("v").cast("long").alias("width"),
                      F.aggregate(F.slice("v", 2, F.size("v")), F.lit(0.0), lambda a, x: a + x).alias("bits_set"))


def score_with_function(spark, sf):
    def predict(frame: pd.DataFrame):
        return ["1" if n > 1500 else "0" for n in frame["n_chars"]]

    docs = B.table(spark, sf, "documents").select("doc_id", "n_chars")
    return T.score_with_function(docs, ["n_chars"], predict).select("doc_id", "prediction_label")


def _isolated(spark, sf):
    """Days scored by a model that does not know refunds."""
    def predict(frame: pd.DataFrame):
        if (frame["event_type"] == "refund").any():
            raise ValueError("unknown event type refund")
        return ["high" if v > 100 else "low" for v in frame["value"].fillna(0)]

    return T.score_isolated(B.events_drifted(spark, sf), ["batch_id"], ["event_type", "value"], predict)


def failed_runs(spark, sf):
    return T.failed_runs(_isolated(spark, sf)[1], ["batch_id"])


def isolated_scores(spark, sf):
    return _isolated(spark, sf)[0].groupBy("batch_id", "prediction_label").agg(F.count("*").alias("n"))


def class_weights(spark, sf):
    return rounded(T.class_weights(_labelled(spark, sf), "quality").withColumnRenamed("_weight", "weight"), "weight")


def validation_sample(spark, sf):
    return SA.validation_sample(B.events_baseline(spark, sf), ["event_id", "value", "event_type"], ["event_id"])


def target_classes(spark, sf):
    return SA.target_classes(B.table(spark, sf, "labels"), "quality")


QUERIES = {
    "failed_runs": failed_runs, "isolated_scores": isolated_scores,
    "train_classifier": _metrics("logistic_regression"),
    "train_decision_tree": _metrics("decision_tree"),
    "train_balanced_forest": _metrics("balanced_random_forest"),
    "preprocess_features": preprocess_features, "score_with_function": score_with_function,
    "class_weights": class_weights, "validation_sample": validation_sample, "target_classes": target_classes,
}

ORACLES = {
    "failed_runs": f"""WITH {B.EVENTS_DRIFTED_SQL}
SELECT batch_id, 'FAILED' AS status, count(*) AS row_count, 'ValueError: unknown event type refund' AS message
FROM batch GROUP BY batch_id HAVING count(*) FILTER (event_type = 'refund') > 0""",
    "isolated_scores": f"""WITH {B.EVENTS_DRIFTED_SQL}
SELECT batch_id, CASE WHEN coalesce(value, 0) > 100 THEN 'high' ELSE 'low' END AS prediction_label, count(*) AS n FROM batch
WHERE batch_id NOT IN (SELECT batch_id FROM batch WHERE event_type = 'refund') GROUP BY 1, 2""",
    "preprocess_features": """SELECT doc_id, 1 + (SELECT count(DISTINCT lang) + count(DISTINCT source) FROM documents) AS width, 2 AS bits_set FROM documents""",
    "score_with_function": f"SELECT doc_id, {B.PREDICTION_RULE} AS prediction_label FROM documents",
    "class_weights": """SELECT CAST(quality AS VARCHAR) AS quality, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM labels JOIN documents USING (doc_id) GROUP BY quality""",
    "validation_sample": f"""WITH {B.EVENTS_SQL} SELECT event_id, value, event_type FROM base
ORDER BY md5(concat_ws('|', '42', CAST(event_id AS VARCHAR))) LIMIT 50""",
    "target_classes": "SELECT DISTINCT CAST(quality AS VARCHAR) AS label FROM labels WHERE quality IS NOT NULL",
}
