"""M-3: updates of tasks in a batch, with what follows from them for children and parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .rollups import parent_rollup

#: Columns of a patch that are no fields.
HEAD = ["task_id", "actor_id", "actor_role", "given"]


def patch_tasks(tasks: DataFrame, patches: DataFrame, approvers: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """(tasks afterwards, verdicts by task_id). patches: HEAD and new values; `given` names the fields that a patch sets, to null too.

    tasks: task_id (a key), parent_task_id, is_group_parent, assignee_id, status, percent_complete, completed_at and any fields. A member
    edits own tasks only and hands none on. Complete by a role that may not approve becomes Pending Review. The stamp of
    completion comes and goes with the status. All patches first; then description and due date of a patched parent reach its
    children that aren't complete; then parents of patched children are counted anew (A-17), their stamps left as they are.
    """
    fields = [c for c in patches.columns if c not in HEAD]
    new = patches.select("task_id", "actor_id", "actor_role", "given", *(F.col(c).alias(f"__{c}") for c in fields))
    met = tasks.join(new, "task_id", "left")
    given = lambda c: F.array_contains("given", c)
    member = F.col("actor_role") == "member"
    verdict = F.when(F.col("given").isNull(), None).when(member & ~F.col("assignee_id").eqNullSafe(F.col("actor_id")), "own only")
    if "assignee_id" in fields:
        verdict = verdict.when(member & given("assignee_id") & ~F.col("__assignee_id").eqNullSafe(F.col("actor_id")), "no handing on")
    met = met.withColumn("verdict", verdict.otherwise("written")).withColumn("__ok", F.coalesce(F.col("verdict") == "written", F.lit(False)))
    value = {c: F.when(F.col("__ok") & given(c), F.col(f"__{c}")).otherwise(F.col(c)) for c in fields}
    if "status" in fields:
        asked = F.when((F.col("__status") == "Complete") & ~F.col("actor_role").isin(approvers), "Pending Review").otherwise(F.col("__status"))
        set_ = F.col("__ok") & given("status")
        value["status"] = F.when(set_, asked).otherwise(F.col("status"))
        was, is_ = F.col("status").eqNullSafe("Complete"), asked.eqNullSafe("Complete")
        value["completed_at"] = F.when(set_ & is_ & ~was, now).when(set_ & ~is_ & was, None).otherwise(F.col("completed_at"))
    patched = met.select(*(value[c].alias(c) if c in value else F.col(c) for c in tasks.columns), "__ok", *(F.coalesce(F.col("__ok") & F.col("is_group_parent") & given(c), F.lit(False)).alias(f"__pass_{c}") for c in ("description", "due_date") if c in fields))
    passed = [c for c in ("description", "due_date") if c in fields]
    # what follows is found for narrow rows and meets the tasks by their own id, so that whole rows are dealt once
    out = patched
    if passed:
        handed = patched.where("is_group_parent").where(" OR ".join(f"__pass_{c}" for c in passed)).select(F.col("task_id").alias("parent_task_id"), *(F.struct(F.col(f"__pass_{c}").alias("set"), F.col(c).alias("value")).alias(f"__from_{c}") for c in passed))
        heirs = tasks.select("task_id", "parent_task_id").join(handed, "parent_task_id").groupBy("task_id").agg(*(F.first(f"__from_{c}").alias(f"__from_{c}") for c in passed))
        out = out.join(heirs, "task_id", "left")
        open_ = F.col("status").isin([v for v in X.TASK_STATUS if v != "Complete"])
        out = out.withColumns({c: F.when(open_ & F.coalesce(F.col(f"__from_{c}.set"), F.lit(False)), F.col(f"__from_{c}.value")).otherwise(F.col(c)) for c in passed})
    children = patched.where("parent_task_id IS NOT NULL").select(F.col("parent_task_id").alias("parent_id"), "status", "percent_complete", "__ok")
    counted = parent_rollup(children, F.max("__ok").alias("moved")).where("moved").select(F.col("parent_id").alias("task_id"), F.col("percent_complete").alias("__p"), F.col("status").alias("__s"))
    out = out.join(counted, "task_id", "left").withColumns({"percent_complete": F.coalesce(F.col("__p").cast(tasks.schema["percent_complete"].dataType), "percent_complete"), "status": F.coalesce("__s", "status")})
    said = patches.select("task_id").join(met.select("task_id", "verdict"), "task_id", "left").select("task_id", F.coalesce("verdict", F.lit("not found")).alias("verdict"))
    return out.select(*tasks.columns), said
