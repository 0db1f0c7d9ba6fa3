"""Many models in one job, alerts from stored runs, isolated failures and rejected files."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from batchwatch import schemas as S
from batchwatch.operators import train as T
from batchwatch.plans import alerting as A
from batchwatch.plans import fleet as Fl
from batchwatch.sources import arrivals as Ar


def test_a_thousand_models_share_one_job(spark):
    """Every model has a column name of its own; odd ones are shifted, and every third has loose limits."""
    cells = spark.range(1000 * 60).selectExpr("cast(id div 60 AS string) AS model_id", "id % 60 AS row", "id div 60 AS m")
    column, number = F.concat(F.lit("x"), F.col("m") % 7), F.col("row") % 20

    def rows(batch, shift):
        base = cells.select("model_id", F.lit(batch).alias("batch_id"), F.col("row").cast("string").alias("row_id"), "m", "row")
        return base.withColumn("column", column).withColumn("value", (number + shift).cast("double").cast("string")).unionByName(
            base.withColumn("column", F.lit("kind")).withColumn("value", F.when(F.col("row") % 2 == 0, "a").otherwise("b"))).select(
            "model_id", "batch_id", "row_id", "column", "value")

    roles = spark.range(1000).selectExpr("cast(id AS string) AS model_id", "concat('x', id % 7) AS column", "'NUMERIC' AS role").unionByName(
        spark.range(1000).selectExpr("cast(id AS string) AS model_id", "'kind' AS column", "'CATEGORICAL' AS role"))
    loose = {"psi_moderate": 1e6, "psi_high": 1e7, "jsd_moderate": 2.0, "jsd_high": 3.0}

    def limits(overrides):
        return F.struct(*[F.lit(float(v)).alias(k) for k, v in {**S.THRESHOLDS, **overrides}.items()])

    models = spark.range(1000).select(
        F.col("id").cast("string").alias("model_id"), F.when(F.col("id") % 3 == 0, limits(loose)).otherwise(limits({})).alias("thresholds"),
        F.array().cast("array<string>").alias("labels"), F.lit(None).cast("string").alias("positive"),
        F.lit(None).cast("double").alias("reference_accuracy"))
    baseline = Fl.profile_fleet(rows("base", F.lit(0)), roles)
    result = Fl.run_fleet(rows("new", F.when(F.col("m") % 2 == 1, 50).otherwise(0)), baseline, models)
    found = {r.model_id: r for r in result.runs.collect()}
    assert len(found) == 1000
    for m in range(1000):
        r = found[str(m)]
        assert (r.row_count, r.features_total) == (60, 2)
        assert r.drift_status == ("HIGH" if m % 2 and m % 3 else "NONE"), m
    statuses = {(r.model_id, r.feature): r.status for r in result.feature_results.collect()}
    assert len(statuses) == 2000 and statuses["1", "x1"] == "HIGH" and statuses["1", "kind"] == "NONE"
    q = {(r.model_id, r.feature): r for r in result.feature_summaries.collect()}
    assert q["1", "x1"].current.median == 59.5 and q["1", "x1"].baseline.median == 9.5 and q["1", "kind"].current.n_unique == 2


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


RAISED = "model_id long, category string, feature string, severity string, rule_code string, headline string, message string, run_id string, created_at timestamp, cooldown double"


def raised(spark, rows):
    return spark.createDataFrame([(m, c, f, s, f"{c}_{s}", f"{s} {run}", "m", run, at(h), 60.0) for m, c, f, s, h, run in rows], RAISED)


def alerts_by_hand(rows):
    out = []
    for key in sorted({r[:3] for r in rows}):
        last = None
        for m, c, f, s, h, run in sorted((r for r in rows if r[:3] == key), key=lambda r: (r[4], r[5])):
            if last is None or h - last["seen"] > 1:
                last = {"key": key, "first": h, "n": 0, "number": (last["number"] + 1) if last else 1}
                out.append(last)
            last |= {"seen": h, "n": last["n"] + 1, "severity": s, "run": run}
    return sorted((*o["key"], o["number"], o["first"], o["seen"], o["n"], o["severity"], o["run"]) for o in out)


def as_rows(alerts):
    hours = lambda t: (t - at(0)).total_seconds() / 3600
    return sorted((r.model_id, r.category, r.feature, r.number, hours(r.first_seen_at), hours(r.last_seen_at),
                   r.occurrence_count, r.severity, r.run_id) for r in alerts.collect())


def test_merging_commit_by_commit_equals_all_at_once(spark):
    rng = random.Random(9)
    rows = [(m, "DRIFT", f, rng.choice((S.WARNING, S.CRITICAL)), h, f"r{h:03}")
            for m in (1, 2) for f in "ab" for h in rng.sample(range(60), 25)]
    nothing = spark.createDataFrame([], A.ALERTS)
    assert as_rows(A.merge_alerts(nothing, raised(spark, rows))) == alerts_by_hand(rows)
    state = nothing
    for low, high in ((0, 20), (20, 21), (21, 60)):
        part = [r for r in rows if low <= r[4] < high]
        again = A.merge_alerts(state, raised(spark, part))
        assert as_rows(again) == as_rows(A.merge_alerts(state, raised(spark, part)))
        state = A.materialise(again, "state")
    assert as_rows(state) == alerts_by_hand(rows)


def test_a_resolved_alert_is_followed_by_a_new_one(spark):
    first = A.merge_alerts(spark.createDataFrame([], A.ALERTS), raised(spark, [(1, "HEALTH", "", S.CRITICAL, 0, "a")]))
    closed = A.materialise(first.withColumn("status", F.lit("RESOLVED")), "closed")
    after = A.merge_alerts(closed, raised(spark, [(1, "HEALTH", "", S.WARNING, 0.5, "b")]))
    assert [(n, s) for n, s in sorted((r.number, r.status) for r in after.collect())] == [(1, "RESOLVED"), (2, "NEW")]


def test_a_failing_batch_fails_alone(spark):
    rows = [(b, float(k)) for b in ("good", "bad", "short", None) for k in range(300)]
    frame = spark.createDataFrame(rows, "batch_id string, x double").repartition(3)

    def predict(part: pd.DataFrame):
        batch = part["x"].sum()
        if part["b"].iloc[0] == "bad" and batch > 0:
            raise RuntimeError("no such thing")
        return ["y"] * (len(part) - (part["b"].iloc[0] == "short"))

    scored, failures = T.score_isolated(frame.withColumn("b", F.coalesce("batch_id", F.lit("none"))), ["batch_id"], ["b", "x"], predict)
    assert {(r.batch_id, r["count"]) for r in scored.groupBy("batch_id").count().collect()} >= {("good", 300)}
    told = {r.batch_id: r for r in T.failed_runs(failures, ["batch_id"]).collect()}
    assert set(told) == {"bad", "short"} and told["bad"].message == "RuntimeError: no such thing" and told["bad"].row_count == 300
    assert told["short"].status == "FAILED" and "predictions for" in told["short"].message
    assert "bad" not in {r.batch_id for r in scored.select("batch_id").distinct().collect()}


def test_files_are_judged_by_their_schemas(spark, tmp_path):
    for name, columns in (("full", "a,b,c"), ("short", "a"), ("more", "a,b,c,d")):
        (tmp_path / f"{name}.csv").write_text(columns + "\n" + ",".join("1" for _ in columns.split(",")) + "\n")
    (tmp_path / "empty.csv").write_text("")
    wide = [f"f{k}" for k in range(10)]
    required = spark.createDataFrame([("b",), ("c",), ("a",)], "feature string")
    rows, verdicts = Ar.admit_files(spark, str(tmp_path), required, "csv")
    told = {r.path.rsplit("/", 1)[1]: r for r in verdicts.collect()}
    assert {k: (v.status, v.missing) for k, v in told.items()} == {
        "full.csv": ("RECEIVED", []), "more.csv": ("RECEIVED", []), "short.csv": ("REJECTED", ["b", "c"]),
        "empty.csv": ("REJECTED", ["a", "b", "c"])}
    assert rows.count() == 2
    many = spark.createDataFrame([(c,) for c in wide], "feature string")
    broken = Ar.judge_files(spark.createDataFrame([("p", ["f0"], None), ("q", [], "OSError: x")],
                                                  "path string, columns array<string>, error string"), many)
    told = {r.path: r for r in broken.collect()}
    assert told["p"].missing == wide[1:] and told["p"].message.endswith("…") and told["q"].message == "File cannot be read: OSError: x"
    of = spark.createDataFrame([("1", "p", ["a"], None), ("2", "q", ["a"], None)], "model_id string, path string, columns array<string>, error string")
    refusals = spark.createDataFrame([("1", None), ("2", "'m' is deactivated and accepts no batches.")], "model_id string, refusal_reason string")
    judged = {r.path: (r.status, r.message) for r in Ar.judge_files(of, spark.createDataFrame([("1", "a"), ("2", "a")], "model_id string, feature string"), refusals).collect()}
    assert judged == {"p": ("RECEIVED", None), "q": ("REJECTED", "'m' is deactivated and accepts no batches.")}


def test_a_key_with_most_rows_in_one_hour_is_cut_into_ranges(spark):
    from batchwatch.operators import alerts as Al
    from batchwatch.operators import ordered as O

    rows = spark.range(20_000).selectExpr(
        "IF(id % 10 < 9, 1L, id) AS model_id", "IF(id % 10 < 9, timestamp_seconds(id % 3600), timestamp_seconds(id * 977)) AS ts", "id AS run")
    sliced = O.in_ranges(rows, ["model_id"], ["ts", "run"])
    sizes = [r["count"] for r in sliced.groupBy("model_id", "_range").count().collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == 20_000 and max(sizes) <= 1.6 * 20_000 / parts
    numbered = O.positions(rows, ["model_id"], ["ts", "run"])
    plain = sorted((r.ts, r.run) for r in rows.where("model_id = 1").collect())
    assert [(r.ts, r.run) for r in numbered.where("model_id = 1").orderBy("position").collect()] == plain
    assert numbered.where("model_id = 1").agg(F.max("position")).first()[0] == len(plain)
    before = {r.run: r.last for r in O.previous_values(rows, ["model_id"], ["ts", "run"], None, {"last": "run"}).where(
        "model_id = 1").collect()}
    assert [before[run] for _, run in plain] == [None, *[run for _, run in plain[:-1]]]
    merged = Al.dedup_alerts(rows, ["model_id"], "ts", "run", 60.0)
    assert merged.where("model_id = 1").select("occurrence_count").collect()[0][0] == len(plain)


def test_rows_of_a_fleet_are_counted_and_never_stored(spark):
    """Rows that come twice, in any order of cells, with missing values, repeated ids and no prediction."""
    rng, rows, brute = random.Random(4), [], {}
    for model, batch in (("m", "a"), ("m", "b"), ("n", "a")):
        for k in range(400):
            key = "r0" if k < 3 else f"r{k}"
            cells = [("x", rng.choice((None, "", "1", "2"))), ("x=", rng.choice(("1", "2"))), ("kind", rng.choice("ab"))]
            cells += [("y", rng.choice((None, "p", "q")))] * (model == "m" and k % 5 > 0) + [("z", rng.choice("pq"))] * (k % 3 > 0)
            rng.shuffle(cells)
            rows += [(model, batch, key, c, v) for c, v in cells]
            brute.setdefault((model, batch), {}).setdefault(key, []).extend(cells)
    feed = spark.createDataFrame(rows, "model_id string, batch_id string, row_id string, column string, value string").repartition(5)
    roles = spark.createDataFrame([(m, c, r) for m in "mn" for c, r in (("x", S.NUMERIC), ("kind", S.CATEGORICAL), ("z", Fl.PREDICTION))]
                                  + [("m", "y", Fl.TARGET)], "model_id string, column string, role string")
    limits = F.struct(*[F.lit(float(v)).alias(k) for k, v in S.THRESHOLDS.items()])
    models = spark.createDataFrame([("m",), ("n",)], "model_id string").select(
        "model_id", limits.alias("thresholds"), F.array(F.lit("p"), F.lit("q")).alias("labels"), F.lit("p").alias("positive"),
        F.lit(None).cast("double").alias("reference_accuracy"))
    baseline, written, store = Fl.profile_fleet(feed, roles), [], Fl.materialise

    def watched(df, name):
        stored = store(df, name)
        written.append((name, stored.count()))
        return stored

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Fl, "materialise", watched)
        result = Fl.run_fleet(feed, baseline, models)
    assert written and max(n for _, n in written) < 100  # of 398 rows a batch
    typed = Fl._typed(feed, roles)
    plan = Fl.row_digests(typed)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    runs = {(r.model_id, r.batch_id): r for r in result.quality_reports.collect()}
    outcomes = {}
    for r in result.confusion.collect():
        outcomes.setdefault((r.model_id, r.batch_id), {})[r.y_true, r.y_pred] = r.n
    assert set(runs) == set(outcomes) == set(brute)
    for key, found in brute.items():
        distinct = {tuple(sorted(((c, v) for c, v in cells if c != "z"), key=str)) for cells in found.values()}
        assert (runs[key].row_count, runs[key].duplicate_rows) == (len(found), len(found) - len(distinct))
        want = {}
        for cells in found.values():
            pair = tuple(max((v for c, v in cells if c == name and v is not None and (name == "z" or key[0] == "m")), default=None) for name in "yz")
            want[pair] = want.get(pair, 0) + 1
        assert outcomes[key] == want


def test_arriving_files_are_written_by_many_tasks(spark, tmp_path):
    from batchwatch.catalog import foundation as Fo

    lines = spark.range(4000).selectExpr(
        "cast(id % 5 AS int) AS l_linenumber", "cast(id AS double) AS l_quantity", "cast(id AS double) AS l_extendedprice",
        "0.1D AS l_discount", "0.02D AS l_tax", "'N' AS l_returnflag", "'O' AS l_linestatus")
    lines.repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")
    per = {}
    for r in Fo._arrived(spark, str(tmp_path))[1].collect():
        number = int(r.path.split("line=")[1][0])
        per.setdefault(number, []).append(r.status)
    assert set(per) == {1, 2, 3, 4} and all(len(found) > 1 for found in per.values())
    told = sorted((r.line, r.missing, r.status) for r in Fo.wide_schema_check(spark, str(tmp_path)).collect())
    assert told == [(1, "", "RECEIVED"), (2, "l_tax", "REJECTED"), (3, "l_discount,l_quantity,l_tax", "REJECTED"), (4, "", "RECEIVED")]
    assert sorted(tuple(r) for r in Fo.accepted_files(spark, str(tmp_path)).collect()) == [(1, "N", 800, 16.0), (4, "N", 800, 16.0)]


def test_columns_of_other_roles_are_left_out_where_cells_arise(spark):
    wide = spark.range(20).selectExpr("cast(id AS string) AS id", "id % 3 AS x", "id % 2 AS y", "cast(id AS string) AS other")
    feed = Fl.long_rows(wide, "m", "'a'", ["id"], ["x", "y", "other"]).unionByName(
        Fl.long_rows(wide, "n", "'a'", ["id"], ["x", "y", "other"]))
    roles = spark.createDataFrame([("m", "x", S.NUMERIC), ("m", "y", Fl.TARGET), ("n", "x", S.CATEGORICAL), ("n", "x", S.NUMERIC)],
                                  "model_id string, column string, role string")
    found = Fl._typed(feed, roles, Fl.TARGET)
    assert {(r.model_id, r.column, r.role) for r in found.collect()} == {("m", "y", Fl.TARGET)} and found.count() == 20
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("= y)")
    assert Fl._typed(feed, roles).count() == 80 and Fl._typed(feed, roles, Fl.PREDICTION).isEmpty()
