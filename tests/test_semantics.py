"""Truth tables of the data model, and the report language's traps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.operators import maintain as M
from cadenza.operators import report as R
from cadenza.operators import rollups as A
from cadenza.sources import sinks
from cadenza.streaming import weekly

D = dt.date(2026, 6, 1)
day = lambda n: D + dt.timedelta(days=n)


@pytest.mark.parametrize(
    "tasks, want",
    [
        ([], ("No Tasks", "gray", 0)),
        ([("Blocked", 9, 0), ("Complete", -1, 100)], ("Blocked", "red", 50)),
        ([("In Progress", -1, 25), ("Complete", -1, 100)], ("At Risk", "red", 63)),
        ([("Complete", 0, 100), ("Complete", 0, 100)], ("Complete", "green", 100)),
        ([("Pending Review", 0, 90), ("Not Started", None, 0)], ("In Progress", "green", 45)),
        ([("Not Started", 0, 0)], ("Not Started", "amber", 0)),
    ],
)
def test_project_rollup(spark, tasks, want):
    rows = [(1, s, None if n is None else day(n), p) for s, n, p in tasks]
    t = spark.createDataFrame(rows, "project_id int, status string, due_date date, percent_complete int")
    r = A.project_rollup(spark.createDataFrame([(1,)], "project_id int"), t, F.lit(D)).first()
    assert (r["status"], r["health"], r["percent_complete"]) == want


def test_due_boundaries(spark):
    rows = [(k, "Not Started", day(k)) for k in (-1, 0, 7, 8)] + [(100, "Complete", day(-1)), (101, "Blocked", None)]
    df = spark.createDataFrame(rows, "k int, s string, d date")
    got = {r[0]: (r[1], r[2]) for r in df.select("k", X.overdue(F.col("s"), F.col("d"), F.lit(D)), X.due_soon(F.col("s"), F.col("d"), F.lit(D))).collect()}
    assert got == {-1: (True, False), 0: (False, True), 7: (False, True), 8: (False, False), 100: (False, False), 101: (False, False)}


def test_mondays_and_locks(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    ts = lambda s: F.to_timestamp(F.lit(s))
    assert one(X.monday(ts("2026-11-29 23:00:00"))) == dt.date(2026, 11, 23)
    assert one(X.monday(ts("2026-11-23 00:00:00"))) == dt.date(2026, 11, 23)
    past = F.lit(dt.date(2026, 11, 16))
    assert one(X.week_locked(past, ts("2026-11-23 08:59:00"))) is False
    assert one(X.week_locked(past, ts("2026-11-23 09:00:00"))) is True
    for hours, want in ((60, "3 late"), (-60, "2 early"), (0, "0 early")):
        done = dt.datetime(2026, 6, 1) + dt.timedelta(hours=hours)
        assert one(X.days_vs_due(ts(str(done)), F.lit(D))) == want


def test_natural_order(spark):
    df = spark.createDataFrame([(c,) for c in ("P10-1", "P2-1", "P1-10", "P1-2")], "c string")
    assert [r[0] for r in df.orderBy(X.natural_key(F.col("c"))).collect()] == ["P1-2", "P1-10", "P2-1", "P10-1"]


def test_report_traps(spark):
    t = {"s": spark.createDataFrame([("10", None), (None, None), ("12abc", None)], "x string, y string")}
    run = lambda metrics, **k: R.run_report(t, R.Spec(["s"], metrics, **k)).collect()
    assert run([R.Metric("sum", "x", "v")])[0]["v"] == 22
    assert run([R.Metric("avg", "x", "v")])[0]["v"] == pytest.approx(22 / 3)
    n = [R.Metric("count", label="n")]
    assert run(n, filters=[R.Filter("x", "lt", 5)])[0]["n"] == 1
    assert run(n, filters=[R.Filter("y", "neq", "a")])[0]["n"] == 3
    assert run(n, filters=[R.Filter("y", "notIn", ["a"])])[0]["n"] == 3
    assert run(n, filters=[R.Filter("y", "notIn", "a")]) == []
    assert run(n, filters=[R.Filter("missing", "eq", None)]) == []
    assert run(n, filters=[R.Filter("y", "eq", None)])[0]["n"] == 3
    assert R.columns_of(R.Spec(["s"], [R.Metric("count"), R.Metric("sum", "x"), R.Metric("avg")], ["y"])) == [("y", "y", "dimension"), ("count", "Count", "metric"), ("sum_x_1", "sum(x)", "metric"), ("avg_value_2", "avg(value)", "metric")]
    with pytest.raises(ValueError):
        R.Spec(["s"], [R.Metric("median")])


def test_decimal_equality_is_by_text(spark):
    t = {"s": spark.createDataFrame([(30000,)], "k int").select(F.col("k").cast("decimal(14,2)").alias("amount"))}
    n = [R.Metric("count", label="n")]
    assert R.run_report(t, R.Spec(["s"], n, filters=[R.Filter("amount", "eq", 30000)])).collect() == []
    assert R.run_report(t, R.Spec(["s"], n, filters=[R.Filter("amount", "eq", "30000.00")])).first()["n"] == 1


def test_merge_keeps_the_survivors_rows(spark):
    e = spark.createDataFrame([(1, "a", 5, 3), (1, "b", 5, 7), (1, "b", 6, 5), (1, "c", 5, 1)], "metric int, user string, period int, count int")
    got = sorted(map(tuple, M.merge_keyed(e, "user", ["metric", "period"], "b", "a").collect()))
    assert got == [(1, "a", 5, 3), (1, "a", 6, 5), (1, "c", 5, 1)]


def test_upsert_null_set_and_audit(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, x string, y int")
    assert sorted(map(str, map(tuple, M.upsert(old, new, ["k"]).collect()))) == sorted(map(str, [(1, "a", 1), (2, "b", 9), (3, "c", 3), (None, "n", 0)]))
    gone = spark.createDataFrame([(2,)], "k int")
    assert {tuple(r) for r in M.set_null(old, gone, "k").collect()} == {(1, "a", 1), (None, "b", 2), (None, "n", 0)}
    after = M.update(old, F.col("k") == 1, y=F.lit(5))
    (row,) = M.audit_rows(old, after, "k", "real", acting_as="other").collect()
    assert (row["target_id"], row["actor_id"]) == ("1", "real") and '"actingAs":"other"' in row["after"] and '"y":1' in row["before"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "k int, t string")
    lines = [r["line"] for r in sinks.csv_lines(df, [("k", "Key"), ("t", "Te,xt")]).orderBy("part", "line").collect()]
    assert lines == ['Key,"Te,xt"', '1,"a ""b"", c"', "2,"]
    assert [r[0] for r in sinks.json_rows(df).collect()] == ['{"k":1,"t":"a \\"b\\", c"}', '{"k":2,"t":null}']
    assert "<td>a &quot;b&quot;, c</td>" in sinks.html_table(df, [("t", "<T>")])
    with pytest.raises(ValueError):
        sinks.html_table(df, [("t", "T")], most=1)
    sinks.write_sheets({"one": df}, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/one").count() == 2


def test_stream_counts_equal_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = weekly.weekly_counts(stream).writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = weekly.weekly_counts(spark.read.parquet(f"{tmp_path}/in"))
    assert sorted(map(tuple, spark.table("weekly").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_refresh_is_latest_row(spark, tmp_path):
    schema = "k int, v string, n int"
    spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", 1)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: weekly.refresh_into(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", ["k"], "n").awaitTermination(120)
    run()
    spark.createDataFrame([(2, "y", 5)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = weekly.current_rows(spark.read.parquet(f"{tmp_path}/out"), ["k"], "n").select("k", "v").collect()
    assert {tuple(r) for r in got} == {(1, "new"), (2, "y")}
