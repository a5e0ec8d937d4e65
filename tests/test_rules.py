"""Rules that the queries' data don't reach: limits, sums, merges, nulls, plans."""

import re

import pytest
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.operators import maintain as M
from cadenza.operators import report as R
from cadenza.plans import catalog, views

SF = "/root/testdata/sf0.001"


def test_clamped_limit():
    assert [X.clamped_limit(n) for n in (None, 0, -1, 1, 500, 501)] == [200, 200, 1, 1, 500, 500]


def test_sums_of_small_and_large_numbers(spark):
    t = spark.createDataFrame([("a", 1e-7, "1e30", 1), ("a", 2e-7, "1e30", 2), ("b", None, "x", None)], "k string, x double, y string, z int")
    t = t.withColumn("d", F.col("z").cast("decimal(14,2)") / 8)
    out = R.run_report({"t": t}, R.Spec(["t"], [R.Metric("sum", "x", "x"), R.Metric("sum", "y", "y"), R.Metric("avg", "d", "d")], ["k"]))
    assert {r["k"]: (r["x"], r["y"], r["d"]) for r in out.collect()} == {"a": (pytest.approx(3e-7), 2e30, pytest.approx(0.1875)), "b": (0.0, 0.0, 0.0)}


def test_upsert_with_nulls_that_replace(spark):
    old = spark.createDataFrame([(1, "a", 5, "x"), (2, "b", 6, "y")], "k int, v string, n int, rest string")
    new = spark.createDataFrame([(1, None, None), (3, "c", 7)], "k int, v string, n int")
    got = sorted(tuple(r) for r in M.upsert(old, new, ["k"], nulls=("v",)).collect())
    assert got == [(1, None, 5, "x"), (2, "b", 6, "y"), (3, "c", 7, None)]


def users(spark):
    rows = [(1, "s@x", "pic", True), (2, None, "", False), (3, "o@x", None, True)]
    return spark.createDataFrame(rows, "user_id bigint, email string, picture string, is_active boolean")


def test_identity_merge(spark):
    """Memberships and entries of both stay once, the survivor's; counts of what moved; the source is retired."""
    tasks = spark.createDataFrame([(1, 2, None), (2, 1, None), (3, 2, 1)], "id int, assignee_id bigint, blocked_by_id bigint")
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "group_id int, user_id bigint")
    entries = spark.createDataFrame([("w1", 2, 3), ("w1", 1, 7), ("w2", 1, 5), ("w2", None, 9)], "week string, user_id bigint, count int")
    out = M.merge_users(users(spark), 1, 2, {"tasks": (tasks, ["assignee_id", "blocked_by_id"])}, {"members": (members, "user_id", ["group_id"]), "entries": (entries, "user_id", ["week"])}, ["email", "picture"])
    rows = lambda name: sorted((tuple(r) for r in out[name].collect()), key=str)
    assert rows("tasks") == [(1, 2, None), (2, 2, None), (3, 2, 2)]
    assert rows("members") == [(1, 2), (2, 2)]
    assert rows("entries") == [("w1", 2, 3), ("w2", 2, 5), ("w2", None, 9)]
    assert rows("users") == [(1, None, None, False), (2, "s@x", "pic", True), (3, "o@x", None, True)]
    assert dict(out["moved"].collect()) == {"tasks.assignee_id": 1, "tasks.blocked_by_id": 1, "members.user_id": 1, "entries.user_id": 1}


@pytest.mark.parametrize("pair", [(1, 99), (99, 2), (1, 1)])
def test_identity_merge_needs_two_accounts(spark, pair):
    with pytest.raises(ValueError, match="Both accounts must exist to merge"):
        M.merge_users(users(spark), *pair, {}, {}, ["email"])


def test_kpi_upsert_rules(spark):
    schema = "metric string, user_id bigint, period_start date, count int, note string"
    day = lambda x: F.to_date(F.lit(x))
    old = spark.createDataFrame([("m", 1, None, 3, "was")], schema).withColumn("period_start", day("2024-01-22"))
    asked = spark.createDataFrame([(1, 1, "member", 4, None, "2024-01-22"), (2, 1, "member", 1, "n", "2024-01-22"), (3, 3, "member", 1, "n", "2024-01-01"), (4, 4, "admin", 0, None, "2024-01-01"), (5, 5, "member", 1, " ok ", "2024-01-08")], "user_id bigint, actor_id bigint, actor_role string, count int, note string, p string")
    asked = asked.select(F.lit("m").alias("metric"), "*", F.to_date("p").alias("period_start")).drop("p")
    over = spark.createDataFrame([("2024-01-08",)], "p string").select(F.to_date("p").alias("period_start"))
    met, after, audit = M.kpi_upsert(old, asked, over, F.to_timestamp(F.lit("2024-01-24 12:00:00")))
    assert {r["user_id"]: r["verdict"] for r in met.collect()} == {1: "evidence", 2: "own only", 3: "locked", 4: "written", 5: "written"}
    assert sorted((r["user_id"], r["count"], r["note"]) for r in after.collect()) == [(1, 3, "was"), (4, 0, None), (5, 1, "ok")]
    assert [(r["user_id"], r["old_count"], r["new_count"]) for r in audit.collect()] == [(5, 0, 1)]


@pytest.mark.parametrize("name", ["a_1_group_members", "a_4_project_rollup", "a_7_portfolio", "a_10_cover", "j_8_nested_tasks", "v_2_needs_attention"])
def test_project_queries_read_no_customers(spark, name):
    found = [k for k in catalog.QUERIES | views.QUERIES if k.startswith(name.rsplit("_", 1)[0]) or k == name]
    for k in found:
        plan = (catalog.QUERIES | views.QUERIES)[k](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("customer.parquet|c_custkey", plan), k
