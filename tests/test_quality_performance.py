"""Quality reports, classifier metrics, explanations and the whole run."""

import pytest
from pyspark.sql import functions as F

from batchwatch.operators import explain as E
from batchwatch.operators import performance as P
from batchwatch.operators import quality as Q
from batchwatch.plans.monitor import profile_baseline, run_monitoring
from batchwatch.sources.sinks import persist_runs, read_children, read_runs
from batchwatch.storage import scratch

KEY = ["batch_id"]


def test_duplicates_count_nulls_as_equal(spark):
    rows = [("b", 1.0, "x"), ("b", 1.0, "x"), ("b", None, "x"), ("b", None, "x"), ("b", None, None), ("c", 1.0, "x")]
    df = spark.createDataFrame(rows, "batch_id string, a double, s string")
    got = {r["batch_id"]: (r["row_count"], r["duplicate_rows"], r["duplicate_pct"]) for r in Q.duplicate_rows(df, KEY).collect()}
    assert got == {"b": (5, 2, 40.0), "c": (1, 0, 0.0)}


def test_digest_keeps_microseconds_and_null_positions_apart(spark):
    df = spark.sql("""SELECT 'b' AS batch_id, TIMESTAMP '2024-01-01 00:00:00.000001' AS t, 'x' AS a, CAST(NULL AS STRING) AS c
      UNION ALL SELECT 'b', TIMESTAMP '2024-01-01 00:00:00.000002', 'x', NULL
      UNION ALL SELECT 'b', TIMESTAMP '2024-01-01 00:00:00.000002', NULL, 'x'""")
    assert Q.duplicate_rows(df, KEY).first()["duplicate_rows"] == 0


def test_a_row_is_shuffled_as_two_longs(spark):
    """Nulls are told from zeros and from each other's places, NaN is null, also in nested and binary cells."""
    df = spark.sql("""SELECT 'b' AS batch_id, 0 AS i, CAST(NULL AS INT) AS j, CAST('NaN' AS DOUBLE) AS x, array(1, NULL) AS l, X'00' AS y
      UNION ALL SELECT 'b', 0, NULL, NULL, array(1, NULL), X'00'
      UNION ALL SELECT 'b', NULL, 0, NULL, array(1, NULL), X'00'
      UNION ALL SELECT 'b', 0, 0, NULL, array(1, NULL), X'00'
      UNION ALL SELECT 'b', 0, NULL, 0.0D, array(1, NULL), X'00'
      UNION ALL SELECT 'b', 0, NULL, -0.0D, array(1, NULL), X'00'
      UNION ALL SELECT 'b', 0, NULL, NULL, array(NULL, 1), X'00'
      UNION ALL SELECT 'b', 0, NULL, NULL, array(1, NULL), X''""")
    found = Q.duplicate_rows(df, KEY).first()
    assert (found["row_count"], found["duplicate_rows"]) == (8, 2)
    plan = Q.duplicate_rows(df, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan and "xxhash64" in plan


def test_quality_score_formula(spark):
    columns = spark.createDataFrame(
        [("b", "x", 100, 10, False, 100, 8, 0), ("b", "c", 100, 0, True, 0, 0, 2)],
        "batch_id string, feature string, rows long, missing long, type_mismatch boolean, numeric_values long, outliers long, unseen long")
    duplicates = spark.createDataFrame([("b", 100, 3, 3.0)], "batch_id string, row_count long, duplicate_rows long, duplicate_pct double")
    row = Q.quality_report(columns, duplicates, KEY).first()
    # missing 5 % * 1.5, duplicates 3, one mismatch 10, one unseen column 3, outliers 8 % * 0.5
    assert row["quality_score"] == round(100 - (7.5 + 3 + 10 + 3 + 4))


def test_penalties_are_capped(spark):
    columns = spark.createDataFrame(
        [("b", f"f{i}", 10, 10, True, 10, 10, 1) for i in range(9)],
        "batch_id string, feature string, rows long, missing long, type_mismatch boolean, numeric_values long, outliers long, unseen long")
    duplicates = spark.createDataFrame([("b", 10, 9, 90.0)], "batch_id string, row_count long, duplicate_rows long, duplicate_pct double")
    assert Q.quality_report(columns, duplicates, KEY).first()["quality_score"] == 0


def outcomes(spark, rows):
    return P.outcome_counts(spark.createDataFrame(rows, "batch_id string, y string, p string"), KEY, "y", "p")


def test_metrics_and_confusion(spark):
    counts = outcomes(spark, [("b", t, p) for t, p in zip("aabb", "abbb")] + [("u", None, "a")])
    matrix = {(r["y_true"], r["y_pred"]): r["n"] for r in P.confusion_matrix(counts, KEY, ["a", "b"]).collect()}
    assert matrix == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 2}
    rows = {r["batch_id"]: r for r in P.performance_block(counts, KEY, ["a", "b"], "b").collect()}
    b, u = rows["b"], rows["u"]
    assert b["accuracy"] == 0.75 and b["precision_positive"] == pytest.approx(2 / 3) and b["recall_positive"] == 1.0
    assert b["precision_macro"] == pytest.approx((1 + 2 / 3) / 2)
    # unknown is null, never 0
    assert u["accuracy"] is None and u["f1_macro"] is None and not u["labels_available"] and u["sample_count"] == 1


def test_one_predicted_class_and_positive_rules(spark):
    counts = outcomes(spark, [("b", "a", "a"), ("b", "b", "a"), ("b", "z", "a")])
    row = P.performance_block(counts, KEY, ["a", "b"], "b").first()
    assert row["precision_positive"] == 0.0 and row["accuracy"] == pytest.approx(1 / 3)
    assert P.performance_block(counts, KEY, ["a", "b", "z"], "b").first()["precision_positive"] is None
    assert P.performance_block(counts, KEY, ["a", "b"], "q").first()["positive_class"] is None


def test_classes_never_predicted_show_as_zero(spark):
    counts = outcomes(spark, [("b", None, "a"), ("b", None, "a")])
    got = {r["label"]: (r["n"], r["share"]) for r in P.prediction_distribution(counts, KEY, ["a", "b"]).collect()}
    assert got == {"a": (2, 1.0), "b": (0, 0.0)}


@pytest.fixture(scope="module")
def monitored(spark):
    base = spark.range(2000).select(
        "id", (F.randn(1) * 10 + 50).alias("amount"),
        F.when(F.col("id") % 10 < 6, "Month-to-month").when(F.col("id") % 10 < 9, "One year").otherwise("Two year").alias("contract"),
        F.when(F.col("id") % 4 == 0, "yes").otherwise("no").alias("target"))
    clean = spark.range(600).select(
        F.lit("clean").alias("batch_id"), (F.col("id") + 10_000).alias("id"), (F.randn(2) * 10 + 50).alias("amount"),
        F.when(F.col("id") % 10 < 6, "Month-to-month").when(F.col("id") % 10 < 9, "One year").otherwise("Two year").alias("contract"),
        F.when(F.col("id") % 4 == 0, "yes").otherwise("no").alias("target"))
    bad = spark.range(600).select(
        F.lit("bad").alias("batch_id"), (F.col("id") + 20_000).alias("id"),
        F.when(F.col("id") % 10 > 0, F.randn(3) * 14 + 72).alias("amount"),
        F.when(F.col("id") % 10 < 9, "Crypto Wallet").otherwise("One year").alias("contract"),
        F.lit(None).cast("string").alias("target"))
    baseline = profile_baseline(base, ["amount"], ["contract"])
    mix = spark.createDataFrame([("no", 1500), ("yes", 500)], "y_pred string, n long")
    result = run_monitoring(
        clean.unionByName(bad), baseline, KEY, F.when(F.col("amount") > 60, "yes").otherwise("no"),
        target="target", labels=["no", "yes"], positive="yes", baseline_mix=mix, reference_accuracy=0.6)
    return result


def test_whole_run(monitored):
    rows = {r["batch_id"]: r for r in monitored.runs.collect()}
    assert rows["clean"]["drift_status"] == "NONE" and rows["clean"]["quality_score"] >= 95
    assert rows["clean"]["labels_available"] and rows["clean"]["weighting"] == "with_labels"
    bad = rows["bad"]
    assert bad["drift_status"] == "HIGH" and bad["accuracy"] is None and bad["weighting"] == "without_labels"
    assert bad["health_score"] <= 79 and bad["quality_score"] < rows["clean"]["quality_score"]


def test_explanations(monitored):
    text = {(r["batch_id"], r["feature"]): r["explanation"] for r in monitored.feature_results.collect()}
    assert text[("clean", "amount")].startswith("No drift in `amount`. The average is ")
    assert "rose from" in text[("bad", "amount")] and "Missing values also rose from 0.0% to 10.0%" in text[("bad", "amount")]
    assert "*Crypto Wallet* rose from 0.0% to 90.0% (+90.0 points) while *Month-to-month* fell" in text[("bad", "contract")]
    assert "which never appeared in the baseline data" in text[("bad", "contract")]
    assert "confirming the two distributions differ" in text[("bad", "contract")]


def test_persisted_runs_show_whole_commits_only(spark, monitored):
    root = scratch(spark, "persist")
    persist_runs(monitored.tables(), root, "1")
    persist_runs(monitored.tables(), root, "1")  # a repeated commit replaces itself
    assert read_runs(spark, root).count() == 2
    assert read_children(spark, root, "feature_results").count() == 4
    # a commit that never wrote its runs stays invisible
    monitored.feature_results.write.parquet(f"{root}/feature_results/commit=2")
    assert read_children(spark, root, "feature_results").count() == 4


def test_movers_ignore_half_a_point_and_order_by_size(spark):
    from batchwatch.operators.categories import category_baseline
    base = category_baseline(spark.createDataFrame(
        [("f", "a", 500), ("f", "b", 300), ("f", "c", 196), ("f", "d", 4)], "feature string, category string, n long"))
    counts = spark.createDataFrame(
        [("x", "f", "a", 300), ("x", "f", "c", 300), ("x", "f", "n", 392), ("x", "f", "d", 8)],
        "batch_id string, feature string, category string, n long")
    got = [(r["category"], r["direction"], r["place"]) for r in E.top_movers(counts, base, KEY).orderBy("direction", "place").collect()]
    assert got == [("b", "down", 1), ("a", "down", 2), ("n", "up", 1), ("c", "up", 2)]
