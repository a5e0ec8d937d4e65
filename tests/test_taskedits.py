"""Updates of tasks: who may, what a status brings with it, what parents and children take."""

import re

import pytest
from pyspark.sql import functions as F

from cadenza.operators.taskedits import patch_tasks
from cadenza.plans import services

TASKS = "task_id string, parent_task_id string, is_group_parent boolean, assignee_id int, status string, percent_complete int, due_date string, description string, completed_at string, note string"
PATCH = "task_id string, actor_id int, actor_role string, given array<string>, status string, percent_complete int, assignee_id int, description string, due_date string"
ROWS = [
    ("g", None, True, 1, "Not Started", 0, "d0", "old", None, "n"),
    ("a", "g", False, 1, "In Progress", 50, "d0", "old", None, "n"),
    ("b", "g", False, 2, "Complete", 100, "d0", "old", "t0", "n"),
    ("c", "g", False, 3, None, None, None, None, None, None),
    ("z", None, False, 3, "Blocked", 10, "d0", "old", None, "n"),
]


def run(spark, *patches):
    after, said = patch_tasks(spark.createDataFrame(ROWS, TASKS), spark.createDataFrame(list(patches), PATCH), ["lead"], F.lit("now"))
    return {r["task_id"]: r.asDict() for r in after.collect()}, {r["task_id"]: r["verdict"] for r in said.collect()}


def patch(task, actor, role, **new):
    return (task, actor, role, sorted(new), *(new.get(c) for c in ("status", "percent_complete", "assignee_id", "description", "due_date")))


@pytest.mark.parametrize("actor, role, new, want", [
    (2, "member", {"status": "Blocked"}, "own only"), (1, "member", {"assignee_id": 2}, "no handing on"), (1, "member", {"assignee_id": None}, "no handing on"),
    (1, "member", {"assignee_id": 1}, "written"), (9, "lead", {"assignee_id": 2}, "written"), (None, "member", {}, "own only")])
def test_who_may(spark, actor, role, new, want):
    after, said = run(spark, patch("a", actor, role, **new), patch("no", 1, "lead"))
    assert said == {"a": want, "no": "not found"}
    if want != "written":
        assert after["a"] == dict(zip(after["a"], ROWS[1], strict=True)) and after["g"]["status"] == "Not Started"


def test_completion(spark):
    after, _ = run(spark, patch("a", 1, "member", status="Complete"), patch("b", 9, "lead", status="In Progress"), patch("z", 9, "lead", status="Complete", percent_complete=100))
    assert (after["a"]["status"], after["a"]["completed_at"]) == ("Pending Review", None)
    assert (after["b"]["status"], after["b"]["completed_at"]) == ("In Progress", None)
    assert (after["z"]["status"], after["z"]["completed_at"], after["z"]["percent_complete"]) == ("Complete", "now", 100)
    assert run(spark, patch("b", 9, "lead", status="Complete"))[0]["b"]["completed_at"] == "t0"


def test_parents_and_children(spark):
    after, _ = run(spark, patch("g", 9, "lead", description="new", due_date=None), patch("a", 9, "lead", status="Blocked", percent_complete=20))
    assert (after["a"]["description"], after["a"]["due_date"]) == ("new", None)
    assert (after["b"]["description"], after["b"]["due_date"]) == ("old", "d0")  # complete
    assert after["c"]["description"] is None  # of no known status
    assert (after["g"]["status"], after["g"]["percent_complete"], after["g"]["description"]) == ("Blocked", 60, "new")
    assert after["z"] == dict(zip(after["z"], ROWS[4], strict=True))


def test_a_patch_without_fields_counts_its_parent_anew(spark):
    after, _ = run(spark, patch("a", 1, "member"))
    assert (after["g"]["status"], after["g"]["percent_complete"]) == ("In Progress", 75)
    assert run(spark)[1] == {}


def test_whole_tasks_are_dealt_once(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = services.m_3_patched_tasks(spark, "/root/testdata/sf0.001")
        text = spark._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    dealt = re.findall(r"\n\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", text)
    assert len(dealt) > 2 and sum("completed_at" in columns for columns in dealt) == 1
