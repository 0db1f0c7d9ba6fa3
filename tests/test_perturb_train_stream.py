"""Perturbation, training and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from batchwatch.operators import perturb as P
from batchwatch.operators import train as T
from batchwatch.sources import readers as R
from batchwatch.storage import scratch
from batchwatch.streaming import monitor as M
from batchwatch.streaming import sources as St

KEY, ROW = ["batch_id"], ["id"]


@pytest.fixture(scope="module")
def batches(spark):
    return spark.createDataFrame(
        [("hot" if i < 700 else "cold", i, 100.0 + (i * 37) % 41, "A" if i % 10 < 6 else "B" if i % 10 < 9 else "C")
         for i in range(1000)], "batch_id string, id long, amount double, grade string")


def test_shift_hits_the_exact_share(spark, batches):
    out = P.numeric_shift(batches, "amount", 2.0, 10.0, KEY, ROW, 0.22).alias("n").join(batches.alias("o"), "id")
    moved = out.filter("n.amount <> o.amount").groupBy("o.batch_id").count()
    assert {r["batch_id"]: r["count"] for r in moved.collect()} == {"hot": 154, "cold": 66}
    assert P.numeric_shift(batches, "amount", 2.0, 0.0, KEY, ROW) is batches


def test_scale_keeps_the_centre(spark, batches):
    stats = lambda df: df.groupBy("batch_id").agg(F.avg("amount").alias("m"), F.stddev_pop("amount").alias("s")).orderBy("batch_id").collect()
    for a, b in zip(stats(batches), stats(P.numeric_scale(batches, "amount", 1.4, KEY))):
        assert b["m"] == pytest.approx(a["m"]) and b["s"] == pytest.approx(1.4 * a["s"])


def test_missing_outliers_and_duplicates(spark, batches):
    holes = P.missing_injection(batches, "amount", 0.1, KEY, ROW)
    assert holes.filter("amount IS NULL").count() == 100
    profile = {"q1": 90.0, "q3": 110.0, "std": 5.0, "max": 120.0}
    assert P.outlier_injection(batches, "amount", 0.04, profile, KEY, ROW).filter("amount = 210.0").count() == 40
    assert P.outlier_target({"q1": 5.0, "q3": 5.0, "std": 2.0, "max": 9.0}) == 19.0
    assert P.outlier_target({"q1": 5.0, "q3": 5.0, "std": 0.0, "max": 5.0}) is None
    assert P.duplicate_injection(batches, 0.05, KEY, ROW).count() == 1050
    assert P.duplicate_injection(batches, 1.5, KEY, ROW).count() == 2500


def test_category_shift_reaches_the_mix_and_keeps_the_size(spark, batches):
    out = P.category_shift(batches, "grade", {"C": 0.9, "A": 0.1, "absent": 0.5}, KEY, ROW)
    got = {(r["batch_id"], r["grade"]): r["count"] for r in out.groupBy("batch_id", "grade").count().collect()}
    assert got == {("hot", "C"): 630, ("hot", "A"): 70, ("cold", "C"): 270, ("cold", "A"): 30}
    assert out.select("batch_id", "id").distinct().count() == 1000  # copies have keys of their own
    assert P.category_shift(batches, "grade", {"absent": 1.0}, KEY, ROW).count() == 1000


def training_rows(spark):
    return spark.createDataFrame(
        [(i, float(i % 50), "x" if i % 3 else "y", None if i % 97 == 0 else ("yes" if (i % 50) > 38 or i % 11 == 0 else "no"))
         for i in range(600)], "id long, amount double, kind string, target string")


def test_training_evaluates_on_held_out_rows_and_scores_new_categories(spark):
    trained = T.train_classifier(training_rows(spark), "target", ["amount"], ["kind"], ["id"], "decision_tree", "yes")
    row = trained.metrics.first()
    assert row["accuracy"] > 0.8 and row["averaging"] == "positive class"
    fresh = spark.createDataFrame([(1, 45.0, "never seen"), (2, None, None)], "id long, amount double, kind string")
    scored = T.score_with_model(trained.model, fresh, ["amount"], ["kind"])
    assert scored.count() == 2 and {r["prediction_label"] for r in scored.collect()} <= {"yes", "no"}
    shares = {r["split"]: r["count"] for r in trained.train.withColumn("split", F.lit("train")).unionByName(
        trained.test.withColumn("split", F.lit("test"))).groupBy("split").count().collect()}
    assert abs(shares["test"] / sum(shares.values()) - 0.25) < 0.01


def test_training_admission(spark):
    rows = training_rows(spark)
    args = (["amount"], ["kind"], ["id"], "decision_tree")
    for bad, target in ((rows, "nope"), (rows.limit(50), "target"), (rows.withColumn("target", F.lit("a")), "target")):
        with pytest.raises(ValueError):
            T.train_classifier(bad, target, *args)
    with pytest.raises(ValueError):
        T.fit_classifier(rows.na.drop(), "target", ["amount"], ["kind"], "oracle")


def test_python_models_must_answer_every_row(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    assert T.score_with_function(df, ["x"], lambda f: ["a"] * len(f)).count() == 10
    with pytest.raises(Exception, match="predictions for"):
        T.score_with_function(df, ["x"], lambda f: ["a"]).collect()


def test_consecutive_runs_across_micro_batches(spark):
    folder = scratch(spark, "runs")
    t0 = dt.datetime(2024, 1, 1)
    schema = "model_id string, run_id long, created_at timestamp, health_score double"
    for i, scores in enumerate([[90.0, 50.0], [40.0, None], [30.0, 95.0]]):
        rows = [("m", 2 * i + j, t0 + dt.timedelta(days=2 * i + j), s) for j, s in enumerate(scores)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = St.folder_stream(spark, folder, spark.read.parquet(folder).schema, 1)
    out = scratch(spark, "flags")
    M.stream_consecutive(stream, "health_score", F.lit(60), out, scratch(spark, "state"), scratch(spark, "ckpt"))
    got = {r["run_id"]: r["alarm"] for r in spark.read.parquet(out).collect()}
    assert got == {0: False, 1: False, 2: True, 4: True, 5: False}


def test_sessions_in_a_stream_use_the_inclusive_cooldown(spark):
    folder = scratch(spark, "occ")
    t0 = dt.datetime(2024, 1, 1)
    times = [0, 3600_000_000, 2 * 3600_000_000 + 1, 10 * 3600_000_000, 400 * 3600_000_000]
    spark.createDataFrame([("m", t0 + dt.timedelta(microseconds=t), i) for i, t in enumerate(times)],
                          "model_id string, ts timestamp, event_id long").coalesce(1).write.parquet(folder)
    stream = St.folder_stream(spark, folder, spark.read.parquet(folder).schema)
    out = St.drain_to_table(M.stream_alert_dedup(stream, ["model_id"], "ts", "event_id", "1 hour"), "alerts")
    assert [(r["occurrence_count"], r["event_id"]) for r in out.orderBy("first_seen_at").collect()] == [(2, 1), (1, 2), (1, 3)]


def test_readers(spark):
    path = scratch(spark, "csv") + ".csv"
    spark.range(5).write.option("header", True).csv(path)
    assert R.read_table(spark, path).count() == 5
    with pytest.raises(ValueError):
        R.read_table(spark, "somewhere.xlsx")
    empty = scratch(spark, "empty") + ".parquet"
    spark.range(0).write.parquet(empty)
    with pytest.raises(ValueError):
        R.read_table(spark, empty)
    assert R.load_reference(spark, scratch(spark, "nothing"), path).count() == 5
    row = R.baseline_check(spark.range(10).withColumn("y", F.lit(1)), "y").first()
    assert not row["accepted"] and "fewer than 100 rows" in row["reasons"] and "two distinct" in row["reasons"]
    assert not R.baseline_check(spark.range(10), "y").first()["accepted"]


def test_splits_can_be_written(spark, batches):
    from batchwatch.operators.sampling import three_way_split
    from batchwatch.sources.sinks import write_splits
    root = scratch(spark, "splits")
    write_splits(three_way_split(batches, "grade", ["id"]), root)
    got = {r["split"]: r["count"] for r in spark.read.parquet(root).groupBy("split").count().collect()}
    assert got == {"baseline": 600, "holdout": 200, "test": 200}


def test_holdout_metrics_over_many_classes_and_both_sides(spark):
    from batchwatch.operators.train import holdout_metrics

    # the last third of 1,500 classes is always wrong; one class is predicted and never true
    rows = [(str(k), str(k) if k < 1000 else "never true") for k in range(1500)] + [(None, "3")]
    row = holdout_metrics(spark.createDataFrame(rows, "truth string, prediction_label string"), "truth").first()
    assert row["accuracy"] == pytest.approx(1000 / 1500) and row["sample_count"] == 1500
    assert row["recall"] == pytest.approx(1000 / 1501) and row["f1"] == pytest.approx(1000 / 1501)
    assert row["averaging"] == "macro"


def test_whole_messages_and_names_are_kept(spark):
    from batchwatch.functions.text import plain_number, words
    from batchwatch.operators.alerts import system_alerts

    runs = spark.createDataFrame([(1, "FAILED", "x" * 1500)], "run_id long, status string, message string")
    assert len(system_alerts(runs.limit(0), runs, ["run_id"]).first()["message"]) == 1500
    row = spark.createDataFrame([("a_" * 600_000, 62.5, 60.0)], "t string, a double, b double").select(
        words(F.col("t")).alias("t"), plain_number(F.col("a")).alias("a"), plain_number(F.col("b")).alias("b")).first()
    assert (len(row["t"]), row["a"], row["b"]) == (1_200_000, "62.5", "60")


def test_samples_of_a_hot_group_are_exact(spark):
    from batchwatch.operators.sampling import flag_sample, table_cut

    rows = spark.range(20000).select("id", F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"))
    picked = flag_sample(rows, ["g"], 1, ["id"], F.lit(777)).where("picked").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in picked} == {"a": 777, "b": 777}
    cut = table_cut(rows, 5, ["id"], 15001)
    from batchwatch.operators.sampling import row_hash
    assert rows.where(row_hash(5, "id") <= cut).count() == 15001
    assert table_cut(rows, 5, ["id"], 0) is None


def test_a_batch_without_any_profiled_feature_is_reported(spark):
    from batchwatch.plans.monitor import profile_baseline, run_monitoring

    base = spark.range(200).select("id", (F.col("id") * 1.5).alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    batch = spark.range(50).select(F.lit("b").alias("batch_id"), F.col("id").alias("other"))
    result = run_monitoring(batch, profile_baseline(base, ["x"], ["c"]), ["batch_id"], F.lit("yes"))
    assert {r["status"] for r in result.feature_results.collect()} == {"INSUFFICIENT_DATA"}
    run = result.runs.first()
    assert run["row_count"] == 50 and run["thresholds"]["psi_high"] == 0.25
