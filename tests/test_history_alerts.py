"""Look-back over history, alert deduplication, retraining advice and history queries."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchwatch.functions.status import literal_thresholds
from batchwatch.operators import alerts as A
from batchwatch.operators import history as H
from batchwatch.operators import ordered as O
from batchwatch.operators import retrain as R

T0 = dt.datetime(2024, 1, 1)


def at(**kw):
    return T0 + dt.timedelta(**kw)


def test_sliced_windows_equal_plain_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(("hot" if i % 3 else f"m{i % 7}"), i, at(hours=int(h)), int(v))
            for i, (h, v) in enumerate(zip(rng.integers(0, 24 * 400, 300), rng.integers(0, 9, 300)))]
    df = spark.createDataFrame(rows, "k string, id long, ts timestamp, v long")
    month = F.date_trunc("month", "ts")
    got = O.running_sums(O.previous_values(df, ["k"], ["ts", "id"], month, {"prev": "v"}),
                         ["k"], ["ts", "id"], month, {"total": F.col("v")})
    seen = {}
    want = {}
    for k, i, ts, v in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        prev, total = seen.get(k, (None, 0))
        want[i] = (prev, total + v)
        seen[k] = (v, total + v)
    assert {r["id"]: (r["prev"], r["total"]) for r in got.collect()} == want


def occurrences(spark, times, key="m"):
    return spark.createDataFrame([(key, t, i, f"text {i}") for i, t in enumerate(times)],
                                 "model_id string, ts timestamp, event_id long, message string")


def test_a_burst_is_one_alert_with_the_latest_text(spark):
    df = occurrences(spark, [at(seconds=30 * i) for i in range(20)])
    rows = A.dedup_alerts(df, ["model_id"], "ts", "event_id").collect()
    assert len(rows) == 1 and rows[0]["occurrence_count"] == 20 and rows[0]["message"] == "text 19"


def test_the_cooldown_is_inclusive_to_the_microsecond(spark):
    exact = occurrences(spark, [at(), at(minutes=60)])
    late = occurrences(spark, [at(), at(minutes=60, microseconds=1)])
    assert A.dedup_alerts(exact, ["model_id"], "ts", "event_id").count() == 1
    assert A.dedup_alerts(late, ["model_id"], "ts", "event_id").count() == 2


def test_a_chain_across_days_stays_one_alert_and_a_resolution_starts_anew(spark):
    times = [at(minutes=50 * i) for i in range(60)]  # two days, never an hour apart
    df = occurrences(spark, times)
    assert A.dedup_alerts(df, ["model_id"], "ts", "event_id").count() == 1
    resolved = spark.createDataFrame([("m", at(minutes=60))], "model_id string, ts timestamp")
    got = A.dedup_alerts(df, ["model_id"], "ts", "event_id", 60.0, resolved).orderBy("first_seen_at").collect()
    assert [r["occurrence_count"] for r in got] == [2, 58]


def runs(spark, rows):
    names = ["model_id", "run_id", "created_at", "health_score", "quality_score", "accuracy", "reference_accuracy",
             "features_high", "features_moderate", "drift_status", "version_id"]
    schema = ("model_id string, run_id long, created_at timestamp, health_score long, quality_score long, accuracy double,"
              " reference_accuracy double, features_high long, features_moderate long, drift_status string, version_id string")
    base = dict(model_id="m", health_score=90, quality_score=95, accuracy=None, reference_accuracy=None, features_high=0,
                features_moderate=0, drift_status="NONE", version_id="v")
    return spark.createDataFrame(
        [tuple({**base, "run_id": i, "created_at": at(days=i), **r}[n] for n in names) for i, r in enumerate(rows)], schema)


def advised(spark, rows):
    df = runs(spark, rows)
    df = R.consecutive_below(df, "health_score", F.lit(60), "health_critical_twice")
    df = R.consecutive_below(df, "quality_score", F.lit(50), "quality_poor_twice")
    return R.retrain_recommendations(R.retrain_triggers(df, literal_thresholds()), F.lit("Churn"))


def test_retrain_tiers(spark):
    rows = [dict(), dict(drift_status="HIGH", features_high=1), dict(features_moderate=3), dict(health_score=50),
            dict(health_score=40, features_moderate=3), dict(quality_score=40), dict(quality_score=30),
            dict(accuracy=0.80, reference_accuracy=0.86)]
    got = {r["run_id"]: (r["severity"], len(r["triggers"])) for r in advised(spark, rows).collect()}
    assert got == {1: ("URGENT", 1), 2: ("ADVISED", 1), 4: ("URGENT", 2), 6: ("ADVISED", 1), 7: ("URGENT", 1)}
    text = advised(spark, rows).filter("run_id = 7").first()["message"]
    assert "0.8000 (6.0 points below 0.8600) (threshold: 5 point drop)" in text
    assert text.startswith("Retraining is recommended for Churn.\n") and text.endswith("does not retrain models.")


def test_one_open_recommendation_until_it_is_closed(spark):
    rec = advised(spark, [dict(drift_status="HIGH", features_high=i + 1) for i in range(4)])
    closing = spark.createDataFrame([("m", at(days=1, hours=5), "DISMISSED")], "model_id string, created_at timestamp, action string")
    columns = ["model_id", "run_id", "version_id", "created_at", "severity", "message"]
    opened = R.open_recommendations(rec.select(*columns), closing)
    got = [(r["updates"], r["first_run_id"], r["run_id"], r["status"]) for r in opened.orderBy("opened_at").collect()]
    assert got == [(2, 0, 1, "DISMISSED"), (2, 2, 3, "OPEN")]
    alerts = R.recommendation_alerts(opened, rec, F.lit("Churn")).orderBy("run_id").collect()
    assert [a["run_id"] for a in alerts] == [0, 2] and alerts[0]["severity"] == "CRITICAL"


def test_health_alerts_resolve_after_three_clean_runs(spark):
    alerts = spark.createDataFrame([("m", "HEALTH", "NEW", "t"), ("m", "DRIFT", "NEW", "t"), ("n", "HEALTH", "NEW", "t")],
                                   "model_id string, category string, status string, message string")
    good = runs(spark, [dict(health_score=10), *[dict(health_score=85)] * 3, dict(health_score=None)])
    got = A.auto_resolve(good, alerts, F.lit(80)).collect()
    assert [(r["model_id"], r["category"], r["status"]) for r in got] == [("m", "HEALTH", "RESOLVED")]
    assert A.auto_resolve(runs(spark, [dict(health_score=85)] * 2), alerts, F.lit(80)).count() == 0


def test_run_rules(spark):
    rows = [dict(accuracy=0.70, reference_accuracy=0.81), dict(accuracy=0.75, reference_accuracy=0.81),
            dict(quality_score=69), dict(quality_score=49), dict(health_score=79), dict(health_score=59), dict()]
    got = {r["run_id"]: (r["rule_code"], r["severity"]) for r in A.run_alerts(runs(spark, rows), ["run_id"], literal_thresholds()).collect()}
    assert got == {0: ("PERFORMANCE_DROP_MAJOR", "CRITICAL"), 1: ("PERFORMANCE_DROP_MINOR", "WARNING"),
                   2: ("QUALITY_DEGRADED", "WARNING"), 3: ("QUALITY_POOR", "CRITICAL"),
                   4: ("HEALTH_WARNING", "WARNING"), 5: ("HEALTH_CRITICAL", "CRITICAL")}


def test_downsampling_keeps_the_reference_positions(spark):
    for n, limit in ((1203, 500), (600, 500), (500, 500), (17, 5)):
        df = spark.range(n).select(F.lit("m").alias("model_id"), F.col("id").alias("run_id"),
                                   (F.lit(T0).cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("created_at"))
        got = sorted(r["run_id"] for r in H.downsample(df, ["model_id"], ["created_at", "run_id"], F.to_date("created_at"), limit).collect())
        step = n / limit
        want = list(range(n)) if n <= limit else sorted({int(i * step) for i in range(limit - 1)} | {n - 1})
        assert got == want


def test_threshold_fallback_is_whole_row(spark):
    from batchwatch.schemas import THRESHOLDS, THRESHOLD_TABLE
    own = {**THRESHOLDS, "alpha": 0.001}
    shared = {**THRESHOLDS, "alpha": 0.01, "psi_high": 0.5}
    profiles = spark.createDataFrame([("a", *own.values()), (None, *shared.values())], THRESHOLD_TABLE)
    models = spark.createDataFrame([("a",), ("b",)], "model_id string")
    got = {r["model_id"]: (r["source"], r["alpha"], r["psi_high"]) for r in H.resolve_thresholds(models, profiles).collect()}
    assert got == {"a": ("model", 0.001, 0.25), "b": ("global", 0.01, 0.5)}
    bare = H.resolve_thresholds(models, profiles.filter("model_id = 'zzz'")).collect()
    assert {(r["source"], r["alpha"]) for r in bare} == {("default", 0.05)}


def test_rejection_lists_eight_names(spark):
    required = spark.createDataFrame([(f"f{i:02d}",) for i in range(12)], "feature string")
    present = spark.createDataFrame([("ok", f"f{i:02d}") for i in range(12)] + [("bad", "f00"), ("bad", "extra")],
                                    "batch_id string, feature string")
    row = H.missing_required(present, required, ["batch_id"]).collect()
    assert len(row) == 1 and row[0]["message"] == (
        "Batch is missing 11 required column(s): f01, f02, f03, f04, f05, f06, f07, f08…")


def test_comparison_and_verdict(spark):
    stats = spark.createDataFrame(
        [(1, "V1", 0.9, 0.80, 0.8, 0.5, 0.5, 90.0, 1.0, 10, 3), (2, "V2", None, 0.85, 0.9, 0.6, 0.5, 80.0, 0.0, 4, 1)],
        "version_id long, label string, training_accuracy double, latest_accuracy double, mean_accuracy double, mean_f1 double,"
        " mean_recall double, mean_health double, mean_high_drift double, run_count long, alert_count long")
    pairs = spark.createDataFrame([("m", 1, 2, True)], "model_id string, a_id long, b_id long, compatible boolean")
    rows = {r["measure"]: r["winner"] for r in H.version_comparison(pairs, stats).collect()}
    assert rows["Training accuracy"] is None and rows["Mean recall (positive class)"] is None
    assert rows["Mean health score"] == "a" and rows["Alerts raised"] == "b" and rows["Monitoring runs"] is None
    verdict = H.comparison_verdict(H.version_comparison(pairs, stats)).first()["verdict"]
    assert verdict == "V2 outperforms V1 on 5 of 9 measures, ahead on mean accuracy by 10.0 points, across 14 runs."
    other = H.version_comparison(pairs.withColumn("compatible", F.lit(False)), stats)
    assert other.count() == 8


def test_unknown_sort_and_range_fall_back(spark):
    df = spark.createDataFrame([("r", at(days=-40), "COMPLETED"), ("s", at(days=-3), "COMPLETED"), ("t", at(days=-1), "FAILED")],
                               "run_id string, created_at timestamp, status string")
    now = F.lit(T0).cast("timestamp")
    assert [r["run_id"] for r in H.in_range(df, "nonsense", now).collect()] == ["s"]
    assert H.in_range(df, "all", now).count() == 2


@pytest.mark.parametrize("left,right,want", [
    (["a", "b"], ["b", "a"], True), (["a"], ["a", "b"], False), ([], ["a"], True), (None, ["a"], True)])
def test_schema_compatibility(spark, left, right, want):
    df = spark.createDataFrame([(left, right)], "l array<string>, r array<string>")
    assert df.select(H.schema_compatible(F.col("l"), F.col("r")).alias("x")).first()["x"] is want


def test_feature_history_computes_its_results_once(spark, tmp_path):
    rows = [(m, f, r, at(days=r % 7), "NONE") for m in (1, 2, None) for f in ("a", "b", None) for r in range(9)]
    spark.createDataFrame(rows, "model_id long, feature string, run_id long, created_at timestamp, status string").write.parquet(f"{tmp_path}/r")
    history = H.feature_history(spark.read.parquet(f"{tmp_path}/r"), 4)
    assert history._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {}
    for r in history.collect():
        got.setdefault((r.model_id, r.feature), []).append((r.place, r.created_at, r.run_id))
    last = sorted((at(days=r % 7), r) for r in range(9))[-4:]
    assert len(got) == 9
    for (m, f), found in got.items():
        places = [None] * 4 if m is None or f is None else [1, 2, 3, 4]
        assert sorted(found, key=lambda x: x[1:]) == [(p, *x) for p, x in zip(places, last)]
