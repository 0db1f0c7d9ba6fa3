"""The driver contract: names, SQL counterparts and column names."""

import pytest

import __spark_entry__ as entry
from batchwatch import catalog
from batchwatch.operators.history import COMPARED

SF = "/root/testdata/sf0.001"
DRIFT = next(label for name, label, _ in COMPARED if name == "mean_high_drift")
# training has no SQL form
WITHOUT_SQL = {"train_classifier", "train_decision_tree", "train_balanced_forest"}


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.queries()) - set(catalog.oracles()) == WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns[:2] == ["batch_id", "feature"] and frame.count() == 60


@pytest.mark.parametrize("name", ["infer_schema", "accuracy_error", "alert_dedup", "page", "missing_injection", "stream_quality"])
def test_small_tables_give_the_same_rows_as_sql(spark, name):
    import glob
    import os

    import duckdb

    from tools.check import rows_of

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    assert rows_of(frame.columns, frame.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def _in_both(spark, name):
    import glob
    import os

    import duckdb

    from tools.check import rows_of

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    rows = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    found = rows.collect()
    assert rows_of(rows.columns, found) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
    return found


def test_every_version_is_compared_with_its_predecessor(spark):
    from batchwatch.catalog import bindings as B

    steps = _in_both(spark, "version_steps")
    ids = {}
    for r in B.versions(spark, SF).collect():
        ids.setdefault(r.model_id, []).append(r.version_id)
    pairs = {(m, a, b) for m, v in ids.items() for b, a in zip(sorted(v), sorted(v)[1:])}
    assert {(r.model_id, r.a_id, r.b_id) for r in steps} == pairs and any(len(v) > 2 for v in ids.values())
    names = {}
    runs = {r.run_id: r.version_id for r in B.runs(spark, SF).select("run_id", "version_id").collect()}
    for r in B.feature_results(spark, SF).select("run_id", "feature").collect():
        names.setdefault(runs[r.run_id], set()).add(r.feature)
    same = {(m, a, b) for m, a, b in pairs if not (a in names and b in names) or names[a] == names[b]}
    drift = {(r.model_id, r.a_id, r.b_id) for r in steps if r.measure == DRIFT}
    assert drift == same and {m % 2 for m, _, _ in drift} == {0, 1}
    assert len(_in_both(spark, "version_steps_verdict")) == len(pairs)


def test_the_range_all_holds_every_completed_run(spark):
    from batchwatch.catalog import bindings as B

    done = B.runs(spark, SF).filter("status = 'COMPLETED'").count()
    assert len(_in_both(spark, "range_filter_all")) == done > 0
