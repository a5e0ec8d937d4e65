"""Golden fixtures G1 to G6: small tables of known results, through the same operators as the queries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.operators import merges as G
from cadenza.operators import report as R
from cadenza.operators import rollups as A
from cadenza.plans import catalog
from cadenza.sources import entities as E

OPEN = X.PIPELINE_STAGES[:5]


@pytest.fixture(scope="module")
def opportunities(spark):
    rows = [(7 * k + i, source, f"owner {'ABC'[i % 3]}", f"{30000 + 15000 * i + 5000 * k}.00", stage) for k, source in enumerate(E.SOURCES) for i, stage in enumerate(X.PIPELINE_STAGES)]
    return spark.createDataFrame(rows, "id bigint, source_system string, owner_name string, amount string, stage_canonical string").withColumn("amount", F.col("amount").cast("decimal(14,2)"))


@pytest.fixture(scope="module")
def campaigns(spark):
    rows = [(1, "salesforce", "Referral", 0, 0, 0, "420000.00"), (2, "salesforce", "Webinar", 1200, 540, 180, "260000.00"), (3, "hubspot", "Email", 8400, 3360, 924, "510000.00"), (4, "hubspot", "Paid Social", 0, 0, 2100, "180000.00")]
    return spark.createDataFrame(rows, "id bigint, source_system string, channel string, sends int, opens int, clicks int, influenced_pipeline string").withColumn("influenced_pipeline", F.col("influenced_pipeline").cast("decimal(14,2)"))


def test_g1_pipeline(opportunities):
    by = A.pipeline_by_stage(opportunities).orderBy("position")
    assert [(r["stage"], r["value"], r["n"]) for r in by.collect()] == [(s, 65000.0 + 30000 * i, 2) for i, s in enumerate(X.PIPELINE_STAGES)]
    assert A.pipeline_totals(by).first().asDict() == {"total_value": 1085000.0, "open_value": 625000.0, "total_count": 14}


@pytest.mark.parametrize("together", [False, True])
def test_g2_presets(opportunities, campaigns, together):
    tables = {"opportunities": opportunities, "campaigns": campaigns}
    want = {
        "pipeline_by_stage": [(s, 65000.0 + 30000 * i) for i, s in reversed(list(enumerate(X.PIPELINE_STAGES)))], "pipeline_by_source": [("hubspot", 560000.0), ("salesforce", 525000.0)],
        "influenced_pipeline": [("Email", 510000.0), ("Referral", 420000.0), ("Webinar", 260000.0), ("Paid Social", 180000.0)], "open_by_owner": [("owner A", 4.0), ("owner B", 4.0), ("owner C", 2.0)],
    }
    all_ = R.run_reports(tables, R.PRESETS)
    for name, spec in R.PRESETS.items():
        df = R.report_rows(all_, name, spec) if together else R.run_report(tables, spec)
        assert [tuple(r) for r in df.collect()] == want[name]


def test_g3_marketing(campaigns):
    assert A.marketing_totals(campaigns).first().asDict() == {"sends": 9600, "opens": 3900, "clicks": 3204, "influenced": 1370000.0, "open_rate": 41, "click_rate": 33}
    assert campaigns.where("sends = 0").select(X.percent(F.col("opens"), F.col("sends"))).distinct().collect()[0][0] is None


def test_g4_weekly_kpis(spark, monkeypatch):
    monday = dt.date(2024, 1, 22)
    users = [(i, "member" if i % 2 else "lead") for i in range(9)] + [(20, "admin")]
    now = [(m, i, monday, c) for i in range(9) for m, c in (("one", 6 + i % 7), ("two", 2 + i % 5))]
    past = [(m, i, monday - dt.timedelta(days=7 * w), c) for i in range(6) for w in range(1, 6) for m, c in (("one", 5 + (i + w) % 8), ("two", 2 + (i + w) % 5))]
    monkeypatch.setattr(E, "metrics", lambda s, d: s.createDataFrame([("one", 10, "developers"), ("two", 5, "developers")], "metric string, target bigint, applies_to string"))
    monkeypatch.setattr(E, "metric_users", lambda s, d: s.createDataFrame(users, "user_id bigint, role string"))
    monkeypatch.setattr(E, "metric_entries", lambda s, d: s.createDataFrame([(*r, k, "manual") for k, r in enumerate(now + past)], "metric string, user_id bigint, period_start date, count bigint, id bigint, source string"))
    rows = catalog.filled(spark, "").collect()
    assert len(rows) == 2 * 9 * 6
    week = [r for r in rows if r["period_start"] == monday]
    of = lambda m: [r["count"] for r in sorted(week, key=lambda r: r["user_id"]) if r["metric"] == m]
    assert of("one") == [6, 7, 8, 9, 10, 11, 12, 6, 7] and of("two") == [2, 3, 4, 5, 6, 2, 3, 4, 5]
    assert {r["count"] for r in rows if r["user_id"] > 5 and r["period_start"] < monday} == {0}
    by = {r["metric"]: r.asDict() for r in catalog.QUERIES["a_22_kpi_breakdown"](spark, "").collect()}
    assert (by["one"]["total_actual"], by["one"]["total_target"], by["two"]["total_actual"], by["two"]["total_target"]) == (76, 90, 34, 45)
    team = {r["metric"]: r["on_target"] for r in catalog.QUERIES["a_23_kpi_team"](spark, "").collect()}
    assert team == {"one": 3, "two": 3}


def test_g5_blocked_list(spark, monkeypatch):
    at = dt.datetime(2026, 1, 1)
    rows = [(1, "Blocked", None, None), (2, "Blocked", at, at), (3, "Blocked", at, None), (4, "In Progress", None, None)]
    t = spark.createDataFrame(rows, "project_id bigint, status string, escalated_at timestamp, escalation_resolved_at timestamp").selectExpr("*", "1 AS line_no", "1L AS assignee_id", "1L AS part_id", "CAST(NULL AS date) AS due_date")
    monkeypatch.setattr(E, "tasks", lambda s, d: t)
    assert sorted(r["project_id"] for r in catalog.QUERIES["f_14_blocked_list"](spark, "").collect()) == [1, 2]


def test_g6_identity_merge(spark):
    users = spark.createDataFrame([("target", False, None, None, None), ("source", True, "mail", "hash", "then")], "user_id string, is_active boolean, email string, password string, set_at string")
    merges = spark.createDataFrame([("source", "target", 0)], "source string, target string, position int")
    tasks = spark.createDataFrame([(1, "target", None), (2, "source", None), (3, "target", "source")], "id int, assignee_id string, blocked_by_id string")
    members = spark.createDataFrame([("shared", "target"), ("shared", "source"), ("own", "source")], "group_id string, user_id string")
    entries = spark.createDataFrame([("w1", "target", 3), ("w1", "source", 7), ("w2", "source", 5)], "week string, user_id string, count int")
    out = G.merge_batch(users, merges, {"tasks": (tasks, ["assignee_id", "blocked_by_id"])}, {"members": (members, "user_id", ["group_id"]), "entries": (entries, "user_id", ["week"])}, [("password", "set_at"), ("email",)], ["email", "password", "set_at"])
    assert [r[0] for r in out.tables["tasks"].select("assignee_id").collect()] == ["target"] * 3
    moved = dict(tuple(r) for r in out.moved().collect())
    assert (moved["tasks.assignee_id"], moved["tasks.blocked_by_id"]) == (1, 1)
    assert sorted(tuple(r) for r in out.tables["members"].select("group_id", "user_id").collect()) == [("own", "target"), ("shared", "target")]
    assert sorted(tuple(r) for r in out.tables["entries"].select("week", "user_id", "count").collect()) == [("w1", "target", 3), ("w2", "target", 5)]
    assert sorted(tuple(r) for r in out.users.collect()) == [("source", False, None, None, None), ("target", True, "mail", "hash", "then")]
