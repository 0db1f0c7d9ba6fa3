"""Profiles, sampling, KS and category comparison against brute force on small frames."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchwatch.catalog import drift as queries
from batchwatch.operators import categories as C
from batchwatch.operators import drift as D
from batchwatch.operators import inference as I
from batchwatch.operators import ks as K
from batchwatch.operators import profile as P
from batchwatch.operators import quantiles as Q
from batchwatch.operators import rank_index as R
from batchwatch.operators import sampling as SA
from batchwatch.operators.longform import category_long, numeric_long

KEY = ["batch_id"]


def frame(spark, values, batch="b"):
    return spark.createDataFrame([(batch, None if v is None else float(v)) for v in values], "batch_id string, x double")


def test_profile_matches_numpy(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(50, 10, 1000).round(2)
    row = P.profile_numeric(frame(spark, [*values, None, float("nan")]), ["x"]).first()
    assert (row["n"], row["missing"]) == (1000, 2)
    assert row["std"] == pytest.approx(values.std())
    assert row["q1"] == pytest.approx(np.quantile(values, 0.25))
    edges = np.unique(np.quantile(values, np.linspace(0, 1, 11)))
    assert row["bin_edges"] == pytest.approx(edges.tolist())
    wide = edges.copy()
    wide[0], wide[-1] = -np.inf, np.inf
    assert row["bin_counts"] == np.histogram(values, wide)[0].tolist()


def test_duplicate_constant_and_empty_columns(spark):
    skewed = [0.0] * 800 + list(range(1, 101)) * 2
    row = P.profile_numeric(frame(spark, skewed), ["x"]).first()
    assert len(set(row["bin_edges"])) == len(row["bin_edges"]) and sum(row["bin_counts"]) == 1000
    constant = P.profile_numeric(frame(spark, [5, 5, 5]), ["x"]).first()
    assert constant["bin_edges"] == [5.0, 5.0] and constant["bin_counts"] == [3]
    empty = P.profile_numeric(frame(spark, [None, None]), ["x"]).first()
    assert empty["bin_edges"] == [] and empty["mean"] is None and empty["missing_pct"] == 100.0


def test_batch_values_outside_the_baseline_fall_in_the_outer_bins(spark):
    profile = P.stored_profile(P.profile_numeric(frame(spark, range(101)), ["x"]))
    batch = frame(spark, [500 + i for i in range(200)] + [-5, None, profile.first()["bin_edges"][3]])
    state = D.numeric_state(batch, profile, ["x"], KEY).first()
    assert state["bin_counts"][-1] == 200 and state["bin_counts"][0] == 1
    assert state["bin_counts"][3] == 1  # a value on an inner edge opens the upper bin
    assert state["below_min"] == 1 and state["above_max"] == 200 and state["missing"] == 1


def test_numeric_bins_of_text_columns_count_unparsable_as_present(spark):
    profile = P.stored_profile(P.profile_numeric(frame(spark, range(50)), ["x"]))
    text = spark.createDataFrame([("b", "1"), ("b", "12 USD"), ("b", None), ("b", "nan")], "batch_id string, x string")
    row = D.numeric_state(text, profile, ["x"], KEY).first()
    assert (row["rows"], row["missing"], row["n"], row["unparsable"]) == (4, 1, 1, 2)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.exponential(10, 3000).round(3), np.zeros(700)])
    long = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", 4.0)], "feature string, value double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    rows = {r["feature"]: r["quantiles"] for r in Q.exact_quantiles(long, ["feature"], probs).collect()}
    assert rows["a"] == pytest.approx(np.quantile(values, probs).tolist())
    assert rows["b"] == pytest.approx(np.quantile([1.0, 4.0], probs).tolist())


def test_quantiles_order_only_values_around_the_wanted_ranks(spark, monkeypatch):
    """Both signs, infinities, and a group whose values all lie in one step."""
    rng = np.random.default_rng(8)
    wide = np.concatenate([rng.normal(0, 1000, 20_000), [0.0, -0.0, np.inf, -np.inf]])
    close = 1e9 + np.arange(300)
    long = spark.createDataFrame([("wide", float(v)) for v in wide] + [("close", float(v)) for v in close], "feature string, value double")
    kept, store = {}, Q.materialise

    def watched(df, name):
        kept[name] = store(df, name)
        return kept[name]

    monkeypatch.setattr(Q, "materialise", watched)
    probs = [0.25, 0.5, 0.75]
    rows = {r["feature"]: r["quantiles"] for r in Q.exact_quantiles(long, ["feature"], probs).collect()}
    assert rows["wide"] == pytest.approx(np.quantile(wide, probs).tolist())
    assert rows["close"] == pytest.approx(np.quantile(close, probs).tolist())
    assert kept["value-ranges"].where("feature = 'wide'").count() < 1000


def lines_folder(spark, path):
    spark.range(3000).selectExpr(
        "id AS l_orderkey", "id % 90 AS l_partkey", "id % 7 AS l_suppkey", "cast(id % 4 AS int) AS l_linenumber",
        "cast(id % 50 AS double) AS l_quantity", "cast(id * 7 % 1013 AS double) AS l_extendedprice", "(id % 11) / 100D AS l_discount",
        "(id % 9) / 100D AS l_tax", "substr('ANR', cast(id % 3 AS int) + 1, 1) AS l_returnflag", "'O' AS l_linestatus",
        "timestamp '1995-03-01 00:00:00' + make_interval(cast(id % 3 AS int)) AS l_shipdate").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_a_report_builds_the_index_of_its_baseline_once(spark, tmp_path, monkeypatch):
    built, build = [], R.build_index
    monkeypatch.setattr(R, "build_index", lambda *given: built.append(given) or build(*given))
    assert queries.drift_lines(spark, lines_folder(spark, tmp_path)).count() == 12
    assert len(built) == 1


def test_stored_sides_come_from_the_state_the_results_came_from(spark, tmp_path, monkeypatch):
    made, state_of = [], D.numeric_state_of
    monkeypatch.setattr(D, "numeric_state_of", lambda *given: made.append(given) or state_of(*given))
    found = queries.stored_summary_rows(spark, lines_folder(spark, tmp_path)).where(
        "batch_id = '1996' AND feature = 'l_quantity' AND label = 'Median'").first()
    assert found.current == np.median([i % 50 for i in range(3000) if i % 3 == 1]) and len(made) == 1


def test_a_baseline_is_counted_once_per_kind_of_feature(spark, tmp_path, monkeypatch):
    """Sizes of the categorical side come from the counts that the categories come from."""
    from batchwatch.plans import monitor as M
    read, long = [], D.category_long
    for module in (D, P):
        monkeypatch.setattr(module, "category_long", lambda *given: read.append(given) or long(*given))
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), (None, 3.0)], "c string, x double")
    base = M.profile_baseline(df, ["x"], ["c"])
    assert len(read) == 1
    assert base.sizes.first().asDict() == {"feature": "c", "n": 3, "missing": 1, "missing_pct": 25.0, "n_unique": 2}
    assert sorted((r.category, r.n) for r in base.categories.counts.collect()) == [("a", 2), ("b", 1)]


def ks_reference(spark, values):
    return R.rank_index(spark.createDataFrame([(float(v),) for v in values], "x double"), ["x"])


def test_ks_of_more_than_50000_rows_a_side_uses_all_of_them(spark):
    base = spark.range(70000).select((F.col("id") * 7919 % 70001).cast("double").alias("x"))
    batch = spark.range(60000).select(F.lit("b").alias("batch_id"), (F.col("id") * 104729 % 69997 + 400).cast("double").alias("x"))
    row = K.ks_statistic(batch, R.rank_index(base, ["x"]), ["x"], KEY).first()
    a, b = (np.array([r.x for r in df.select("x").collect()]) for df in (base, batch))
    assert row["ks"] == pytest.approx(brute_ks(a, b), abs=1e-12)
    assert (row["n_reference"], row["n_current"]) == (70000, 60000)
    smaller = K.ks_statistic(batch, R.rank_index(base, ["x"]), ["x"], KEY, effective_size=1000).first()
    assert smaller["ks"] == row["ks"] and smaller["p_value"] > row["p_value"]


def test_ks_looks_up_only_values_of_pages_that_can_hold_the_distance(spark, monkeypatch):
    """A batch shifted in one place, one without drift, one far off and one between two pages."""
    rng = np.random.default_rng(9)
    base = rng.normal(0, 100, 20_000).round(3)
    shifted = np.where((base > 50) & (base < 80), base + 30, base)
    first = np.unique(base)[25 * np.arange(1, 40)]
    batches = {"shifted": shifted, "same": rng.normal(0, 100, 15_000).round(3), "far": np.full(30, 1e6), "between": first - 1e-6}
    rows = [(k, float(v)) for k, vs in batches.items() for v in vs]
    asked, rank_in = {}, K.rank_in

    def watched(at, index, *more):
        asked.update({r["batch_id"]: r["count"] for r in at.groupBy("batch_id").count().collect()})
        return rank_in(at, index, *more)

    monkeypatch.setattr(K, "rank_in", watched)
    index = R.build_index(spark.createDataFrame([("x", float(v)) for v in base], "feature string, value double"), ["feature"], 5)
    got = {r["batch_id"]: r for r in K.ks_statistic(spark.createDataFrame(rows, "batch_id string, x double"), index, ["x"], KEY).collect()}
    for k, v in batches.items():
        assert got[k]["ks"] == pytest.approx(brute_ks(base, v), abs=1e-12), k
        assert got[k]["n_current"] == len(v)
    assert asked["shifted"] < 1000 and asked["same"] < len(np.unique(batches["same"])) / 2


def brute_ks(a, b):
    pooled = np.union1d(a, b)
    fa = np.searchsorted(np.sort(a), pooled, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), pooled, side="right") / len(b)
    return np.abs(fa - fb).max()


def test_ks_equals_brute_force_with_ties_gaps_and_outliers(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 30, 400).astype(float)
    batches = {"same": base[:200], "shift": base[:150] + 3.5, "far": np.full(50, 1e6), "low": np.full(40, -1e6),
               "one": np.array([7.0]), "mixed": np.concatenate([rng.normal(10, 3, 300), base[:20]])}
    rows = [(k, float(v)) for k, vs in batches.items() for v in vs] + [("mixed", None), ("gone", None)]
    df = spark.createDataFrame(rows, "batch_id string, x double")
    got = {r["batch_id"]: r for r in K.ks_statistic(df, ks_reference(spark, base), ["x"], KEY).collect()}
    assert set(got) == set(batches)
    for k, v in batches.items():
        assert got[k]["ks"] == pytest.approx(brute_ks(base, v)), k
        assert got[k]["n_current"] == len(v)
    assert got["far"]["p_value"] < 1e-6 and got["same"]["p_value"] > 0.5


@pytest.mark.parametrize("side", [2, 3, 32])
def test_ranks_and_quantiles_of_an_index_of_many_levels(spark, side):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 5, 300).round(1), np.array([7.0])
    rows = [("a", float(v)) for v in a] + [("b", 7.0), ("a", None), ("none", None)]
    long = spark.createDataFrame(rows, "feature string, value double").select("feature", "value")
    index = R.build_index(long, ["feature"], side)
    asked = [*np.unique(a), *(np.unique(a) + 0.05), -1e9, 1e9]
    frame = spark.createDataFrame([("a", float(v)) for v in asked] + [("b", 7.0), ("b", 8.0), ("b", 6.0), ("else", 1.0)],
                                  "feature string, value double")
    for busy in (R.BUSY_PAGE, 3):
        got = {(r.feature, r.value): (r.below, r.upto) for r in R.rank_of(frame, index, busy).collect()}
        assert got == {("b", 7.0): (0, 1), ("b", 8.0): (1, 1), ("b", 6.0): (0, 0), **{
            ("a", float(v)): (int((a < v).sum()), int((a <= v).sum())) for v in asked}}
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    quantiles = {r.feature: r.quantiles for r in R.quantiles_of(index, probs).collect()}
    assert quantiles["a"] == pytest.approx(np.quantile(a, probs).tolist()) and quantiles["b"] == [7.0] * 6
    moments = {r.feature: r for r in R.moments_of(index).collect()}
    assert moments["a"]["std"] == pytest.approx(a.std()) and moments["a"]["missing"] == 1 and moments["none"]["n"] == 0


def largest_method(spark, df):
    """Bytes of the largest method that Spark generates for a plan; the JVM compiles none beyond 8,000."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        # a plan of its own: the frame's was made before the setting
        text = df.select("*")._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))


def test_the_page_search_is_compiled(spark):
    index = R.rank_index(spark.range(3000).select(F.col("id").cast("double").alias("x")), ["x"])
    assert len(index.levels) == 2
    pages = index.levels[0].join(spark.range(5).select(F.lit("x").alias("feature"), F.col("id").cast("double").alias("value")), "feature")
    assert largest_method(spark, R._found(pages, "value", index.side)) < 8000


def test_a_run_neither_shuffles_nor_writes_the_baseline(spark, tmp_path):
    base = spark.range(300_000).select(F.xxhash64("id").cast("double").alias("x"))
    index = R.rank_index(base, ["x"])
    batch = spark.range(200).select(F.lit("b").alias("batch_id"), (F.xxhash64("id") + F.col("id")).cast("double").alias("x"))
    written = []
    store = R.materialise

    def watched(df, name):
        stored = store(df, name)
        written.append((name, stored.count()))
        return stored

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(R, "materialise", watched)
        patch.setattr(K, "materialise", watched)
        ks = K.ks_statistic(batch, index, ["x"], KEY).first()["ks"]
        assert written and max(n for _, n in written) <= 200
    assert ks == pytest.approx(brute_ks(np.array([r.x for r in base.collect()]), np.array([r.x for r in batch.collect()])))
    asked = batch.select(F.lit("x").alias("feature"), F.col("x").alias("value"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R.rank_of(asked, index)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    page_scan = plan[:plan.index("rank_pages")].splitlines()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    after_join = page_scan[max(k for k, line in enumerate(page_scan) if "SortMergeJoin" in line):]
    assert sum("Exchange" in line for line in after_join) <= 1  # that of the values asked for


def test_ks_of_one_value_that_all_batches_share(spark):
    base = spark.range(5000).select((F.col("id") % 50).cast("double").alias("x"))
    batches = spark.range(30_000).select(F.concat(F.lit("b"), F.col("id") % 3000).alias("batch_id"), F.lit(7.0).alias("x"))
    index = R.rank_index(base, ["x"], side=2)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(R, "BUSY_PAGE", 100)
        counted = batches.groupBy("batch_id", F.lit("x").alias("feature"), F.col("x").alias("value")).agg(F.count("*").alias("c"))
        assert R.rank_of(counted, index, 100).select("below", "upto").distinct().collect() == [(700, 800)]
    got = K.ks_statistic(batches, index, ["x"], KEY).agg(F.count("*").alias("n"), F.min("ks").alias("a"), F.max("ks").alias("b")).first()
    assert (got["n"], got["a"]) == (3000, got["b"]) and got["a"] == pytest.approx(0.84)


def test_reference_sample_is_capped_exact_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 1.5).alias("x"))
    one = {r["id"] for r in SA.reference_sample(df, ["x"], ["id"], 700).collect()}
    two = {r["id"] for r in SA.reference_sample(df.repartition(7), ["x"], ["id"], 700).collect()}
    assert len(one) == 700 and one == two
    assert SA.reference_sample(df, ["x"], ["id"], 5000).count() == 5000


def test_hash_samples_have_exact_sizes_per_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2000, "hot").otherwise("cold").alias("g"))
    flagged = SA.flag_sample(df, ["g"], 42, ["id"], SA.half_even_share(F.col("n"), 0.25))
    assert {r["g"]: r["c"] for r in flagged.groupBy("g").agg(F.count_if("picked").alias("c")).collect()} == {
        "hot": 500, "cold": 250}
    none = SA.flag_sample(df, ["g"], 42, ["id"], F.lit(0).cast("long"))
    assert none.filter("picked").count() == 0
    split = SA.three_way_split(df, "g", ["id"]).groupBy("g", "split").count().collect()
    assert {(r["g"], r["split"]): r["count"] for r in split}[("hot", "baseline")] == 1200


def brute_categories(b, c):
    keys = sorted(set(b) | set(c))
    x, y = np.array([b.get(k, 0) for k in keys], float), np.array([c.get(k, 0) for k in keys], float)

    def smooth(v):
        v = v / v.sum() if v.sum() else v
        return (v + 1e-4) / (v + 1e-4).sum()

    e, a = smooth(x), smooth(y)
    m = (e + a) / 2
    psi = ((a - e) * np.log(a / e)).sum()
    jsd = 0.5 * (e * np.log2(e / m)).sum() + 0.5 * (a * np.log2(a / m)).sum()
    grand = x.sum() + y.sum()
    keep = np.minimum(x.sum(), y.sum()) * (x + y) / grand >= 5
    cols = [(p, q) for p, q, k in zip(x, y, keep) if k]
    if (~keep).any():
        cols.append((x[~keep].sum(), y[~keep].sum()))
    if len(cols) < 2:
        return psi, jsd, 0.0, len(cols)
    t = np.array(cols).T
    expected = np.outer(t.sum(1), t.sum(0)) / t.sum()
    diff = np.abs(t - expected)
    if len(cols) == 2:
        diff = diff - np.minimum(0.5, diff)
    return psi, jsd, (diff**2 / expected).sum(), len(cols)


def test_category_measures_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    base = {"a": 2000, "b": 900, "c": 40, "d": 3, "e": 1, "gone": 600, "rare1": 1, "rare2": 1}
    batches = {
        "same": {"a": 200, "b": 90, "c": 4, "gone": 60}, "flip": {"a": 10, "b": 900, "c": 30},
        "new": {"a": 500, "b": 200, "crypto": 300}, "tiny": {"a": 1}, "only new": {"z": 50, "y": 40},
        "two": {"a": 80, "b": 20}}
    for i in range(4):
        batches[f"r{i}"] = {k: int(v) for k, v in zip("abcdefg", rng.integers(1, 400, 7))}
    counts = spark.createDataFrame(
        [(k, "f", c, n) for k, v in batches.items() for c, n in v.items()], "batch_id string, feature string, category string, n long")
    stored = spark.createDataFrame([("f", c, n) for c, n in base.items()], "feature string, category string, n long")
    got = {r["batch_id"]: r for r in C.category_scores(counts, C.category_baseline(stored), KEY).collect()}
    for k, v in batches.items():
        psi, jsd, chi, columns = brute_categories(base, v)
        assert got[k]["psi"] == pytest.approx(psi, abs=1e-9), k
        assert got[k]["jsd"] == pytest.approx(jsd, abs=1e-9), k
        assert got[k]["chi2"] == pytest.approx(chi, rel=1e-9, abs=1e-9), k
        assert got[k]["columns"] == columns, k
        assert got[k]["n_unseen"] == len(set(v) - set(base)), k


def test_yates_correction_on_a_two_by_two_table(spark):
    counts = spark.createDataFrame([("b", "f", "x", 15), ("b", "f", "y", 35)], "batch_id string, feature string, category string, n long")
    base = spark.createDataFrame([("f", "x", 30), ("f", "y", 20)], "feature string, category string, n long")
    row = C.chi_square(counts, C.category_baseline(base), KEY).first()
    assert row["chi2"] == pytest.approx(7.9192, abs=1e-4)


def test_features_without_baseline_or_batch_values(spark):
    counts = spark.createDataFrame([("b", "f", "x", 15)], "batch_id string, feature string, category string, n long")
    empty = spark.createDataFrame([("other", "q", 1)], "feature string, category string, n long")
    row = C.category_scores(counts, C.category_baseline(empty), KEY).first()
    assert (row["chi2"], row["p_value"], row["n_unseen"]) == (0.0, 1.0, 1)


def test_large_sample_tiny_shift_is_significant_but_not_drift(spark):
    base = spark.range(40000).select(F.randn(1).alias("x"), "id")
    batch = spark.range(40000).select(F.lit("b").alias("batch_id"), (F.randn(2) + 0.05).alias("x"))
    profile = P.stored_profile(P.profile_numeric(base, ["x"]))
    ref = R.rank_index(base, ["x"])
    row = D.drift_report(batch, profile, None, ref, ["x"], [], KEY).first()
    assert row["p_value"] < 0.05 and row["status"] == "NONE"


def test_two_sigma_shift_is_high_small_batches_insufficient_and_absent_reported(spark):
    base = spark.range(5000).select((F.randn(1) * 10 + 50).alias("x"), F.lit("k").alias("c"), "id")
    batch = spark.range(1000).select(F.lit("b").alias("batch_id"), (F.randn(2) * 10 + 70).alias("x")).unionByName(
        spark.range(29).select(F.lit("small").alias("batch_id"), F.randn(3).alias("x")))
    profile = P.stored_profile(P.profile_numeric(base, ["x"]))
    counts = C.category_baseline(P.profile_categories(base, ["c"]))
    ref = R.rank_index(base, ["x"])
    rows = {(r["batch_id"], r["feature"]): r for r in D.drift_report(
        batch, profile, counts, ref, ["x"], ["c"], KEY).collect()}
    assert rows[("b", "x")]["status"] == "HIGH"
    assert rows[("small", "x")]["status"] == "INSUFFICIENT_DATA"
    assert rows[("b", "c")]["status"] == "INSUFFICIENT_DATA" and rows[("b", "c")]["psi"] is None


def test_batch_equal_to_baseline_shows_no_drift(spark):
    base = spark.range(2000).select(F.randn(1).alias("x"), (F.col("id") % 5).cast("string").alias("c"), "id")
    same = base.withColumn("batch_id", F.lit("b"))
    profile = P.stored_profile(P.profile_numeric(base, ["x"]))
    counts = C.category_baseline(P.profile_categories(base, ["c"]))
    ref = R.rank_index(base, ["x"])
    for r in D.drift_report(same, profile, counts, ref, ["x"], ["c"], KEY).collect():
        assert r["status"] == "NONE" and r["psi"] == pytest.approx(0, abs=1e-9)
        assert r["test_statistic"] == pytest.approx(0, abs=1e-9) and r["p_value"] == 1.0


def test_constant_columns(spark):
    base = spark.range(100).select(F.lit(4.0).alias("x"), "id")
    batch = spark.range(50).select(F.lit("same").alias("batch_id"), F.lit(4.0).alias("x")).unionByName(
        spark.range(50).select(F.lit("other").alias("batch_id"), F.lit(5.0).alias("x")))
    profile = P.stored_profile(P.profile_numeric(base, ["x"]))
    rows = {r["batch_id"]: r for r in D.drift_report(batch, profile, None, R.rank_index(base, ["x"]), ["x"], [], KEY).collect()}
    assert (rows["same"]["test_statistic"], rows["same"]["p_value"]) == (0.0, 1.0)
    assert (rows["other"]["test_statistic"], rows["other"]["p_value"]) == (1.0, 0.0)
    assert rows["other"]["psi"] == pytest.approx(0)


def test_categories_are_read_through_the_declared_type(spark):
    widened = spark.createDataFrame([("b", 0.0), ("b", 1.0), ("b", None)], "batch_id string, flag double")
    got = {r["category"] for r in category_long(widened, ["flag"], KEY, {"flag": "bigint"}).collect()}
    assert got == {"0", "1", None}


def test_schema_inference(spark):
    df = spark.range(200).select(
        F.col("id").alias("customer_ref"), (F.col("id") % 2).alias("flag"), (F.col("id") * 0.5).alias("amount"),
        F.lit("x").alias("constant"), F.lit(None).cast("string").alias("nothing"), F.current_timestamp().alias("at"),
        (F.col("id") % 50).alias("order_id"), (F.col("id") % 40).alias("age"),
        F.when(F.col("id") % 3 == 0, "yes").otherwise("no").alias("target"))
    rows = {r["column_name"]: r for r in I.infer_schema(df, "target").collect()}
    assert rows["flag"]["type"] == "CATEGORICAL" and rows["age"]["type"] == "NUMERIC"
    assert rows["amount"]["is_feature"]  # a float is never an identifier
    assert rows["customer_ref"]["exclusion_reason"] == I.REASON_IDENTIFIER
    assert rows["constant"]["exclusion_reason"] == I.REASON_CONSTANT
    assert rows["nothing"]["exclusion_reason"] == I.REASON_EMPTY
    assert rows["at"]["exclusion_reason"] == I.REASON_TIMESTAMP
    assert rows["order_id"]["exclusion_reason"] == I.REASON_NAME
    assert rows["target"]["is_target"] and not rows["target"]["is_feature"]
    assert I.feature_columns(I.infer_schema(df, "target")) == ["flag", "amount", "age"]
    with pytest.raises(ValueError, match="not present"):
        I.infer_schema(df, "nope")


def test_long_form_counts(spark):
    df = spark.createDataFrame([("b", 1.0, 2), ("b", float("nan"), None)], "batch_id string, x double, y int")
    rows = {(r["feature"], r["value"]) for r in numeric_long(df, ["x", "y"], KEY).collect()}
    assert rows == {("x", 1.0), ("x", None), ("y", 2.0), ("y", None)}
    assert not any(isinstance(v, float) and math.isnan(v) for _, v in rows if v is not None)
