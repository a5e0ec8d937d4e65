"""Named rollups: projects, areas, portfolio, workload, initiatives, pipeline, marketing.

Tasks are reduced to one row per project before anything is joined to them; dimension
tables join to those reduced rows, so the fact table is shuffled once, pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def task_counts(tasks: DataFrame, by: list[str], as_of: Column) -> DataFrame:
    """One row per key: counts of tasks and the sum of their percents."""
    s = F.col("status")
    return tasks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("task_count"),
        F.count_if(X.overdue(s, F.col("due_date"), as_of)).alias("overdue_count"),
        F.count_if(s == "Blocked").alias("blocked_count"),
        F.count_if(s == "Complete").alias("complete_count"),
        F.count_if(X.active_status(s)).alias("active_count"),
        F.sum("percent_complete").alias("percent_sum"),
    )


COUNTS = ["task_count", "overdue_count", "blocked_count", "complete_count", "active_count", "percent_sum"]


def project_rollup(projects: DataFrame, tasks: DataFrame, as_of: Column) -> DataFrame:
    """A-4: every project, with or without tasks: counts, percent, status, health."""
    out = projects.join(task_counts(tasks, ["project_id"], as_of), "project_id", "left").fillna(0, COUNTS)
    n = F.col("task_count")
    out = out.withColumn("percent_complete", F.when(n == 0, F.lit(0).cast("bigint")).otherwise(X.round_half_up(F.col("percent_sum") / n)))
    out = out.withColumn("status", X.project_status(n, F.col("blocked_count"), F.col("overdue_count"), F.col("complete_count"), F.col("active_count")))
    return out.withColumn("health", X.health(F.col("status")))


def portfolio(rollup: DataFrame) -> DataFrame:
    """A-7: scalars over projects that have tasks."""
    s, live = F.col("status"), F.col("task_count") > 0
    return rollup.agg(
        F.count_if(live).alias("active_projects"),
        *(F.count_if(live & (s == name)).alias(name.lower().replace(" ", "_")) for name in X.PROJECT_STATUS[1:]),
        F.sum("task_count").alias("total_tasks"), F.sum("overdue_count").alias("overdue_tasks"), F.sum("blocked_count").alias("blocked_tasks"),
        F.coalesce(X.round_half_up(F.avg(F.when(live, F.col("percent_complete")))), F.lit(0)).alias("avg_completion"),
    )


def cover(rollup: DataFrame) -> DataFrame:
    """A-10: the same average over all projects, empty ones as 0; on track is green."""
    return rollup.agg(
        F.count(F.lit(1)).alias("projects"), F.count_if(F.col("health") == "green").alias("on_track"), F.sum("overdue_count").alias("overdue_tasks"),
        F.coalesce(X.round_half_up(F.avg("percent_complete")), F.lit(0)).alias("avg_completion"),
    )


def area_rollup(areas: DataFrame, rollup: DataFrame) -> DataFrame:
    """A-8: task-weighted rollup of every area."""
    by = rollup.groupBy("area_id").agg(F.count(F.lit(1)).alias("project_count"), F.sum("task_count").alias("task_count"), F.sum("percent_sum").alias("percent_sum"), F.max(F.col("overdue_count") > 0).alias("has_overdue"))
    out = areas.join(by, "area_id", "left").fillna(0, ["project_count", "task_count", "percent_sum"]).withColumn("has_overdue", F.coalesce("has_overdue", F.lit(False)))
    n = F.col("task_count")
    return out.withColumn("percent_complete", F.when(n == 0, F.lit(0).cast("bigint")).otherwise(X.round_half_up(F.col("percent_sum") / n)))


def initiatives(areas: DataFrame, rollup: DataFrame, targets: DataFrame) -> DataFrame:
    """A-11, A-13, A-14: tactics of each area, project-weighted percent, status, attainment."""
    h = F.col("health")
    by = rollup.groupBy("area_id").agg(
        F.count(F.lit(1)).alias("tactics"), F.count_if(h == "green").alias("on_track"), F.count_if(h == "red").alias("red"), F.count_if(h == "amber").alias("amber"),
        F.count_if(F.col("status") == "Complete").alias("complete"), F.sum("task_count").alias("tasks"), F.sum("overdue_count").alias("overdue"),
        X.round_half_up(F.avg("percent_complete")).alias("percent_complete"),
    )
    zero = ["tactics", "on_track", "red", "amber", "complete", "tasks", "overdue", "percent_complete"]
    out = areas.join(by, "area_id", "left").fillna(0, zero).join(F.broadcast(targets.select("area_id", "target_numeric", "current_numeric")), "area_id", "left")
    return out.select(
        "area_id", "area_name", "tactics", "on_track", F.coalesce(X.percent(F.col("on_track"), F.col("tactics")), F.lit(0)).alias("on_track_percent"), "tasks", "overdue", "percent_complete",
        X.initiative_status(F.col("tactics"), F.col("complete"), F.col("red"), F.col("amber")).alias("status"),
        F.when(F.col("target_numeric") > 0, X.percent(F.col("current_numeric"), F.col("target_numeric"))).alias("attainment"),
    )


def top_owner(rollup: DataFrame) -> DataFrame:
    """A-12: the owner of most projects of an area; ties go to the smaller id."""
    n = rollup.groupBy("area_id", "owner_id").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("area_id").agg(F.max_by(F.struct("owner_id", "n"), F.struct("n", -F.col("owner_id"))).alias("best"))
    return best.select("area_id", "best.owner_id", "best.n")


def workload(users: DataFrame, tasks: DataFrame, as_of: Column) -> DataFrame:
    """A-9: every user, inactive ones and those without tasks too."""
    by = task_counts(tasks, ["assignee_id"], as_of).withColumnRenamed("assignee_id", "user_id")
    out = users.join(by, "user_id", "left").fillna(0, COUNTS)
    n = F.col("task_count")
    return out.select("user_id", "user_name", n.alias("total"), (n - F.col("complete_count")).alias("open"), F.col("overdue_count").alias("overdue"), F.when(n == 0, F.lit(0).cast("bigint")).otherwise(X.round_half_up(F.col("percent_sum") / n)).alias("percent_complete"))


def breakdown(tasks: DataFrame) -> DataFrame:
    """A-3: tasks by status and by priority in one pass, one row."""
    key = lambda v: v.lower().replace(" ", "_")
    return tasks.agg(*(F.count_if(F.col("status") == v).alias(key(v)) for v in X.TASK_STATUS), *(F.count_if(F.col("priority") == v).alias(key(v)) for v in X.TASK_PRIORITY))


def status_share(tasks: DataFrame) -> DataFrame:
    """A-29: whole percent of tasks by status, absent statuses as 0."""
    spark = tasks.sparkSession
    names = spark.createDataFrame([(v,) for v in X.TASK_STATUS], "status string")
    by = names.join(tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # six rows
    return by.select("status", "n", X.round_half_up(F.col("n") * 100 / F.greatest(total, F.lit(1))).alias("share"))


def snapshot(areas: DataFrame, projects: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """A-15, V-8: totals by area with the snapshot's overdue."""
    by = tasks.groupBy("project_id").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "Complete").alias("complete"), F.count_if(X.overdue_now(F.col("status"), F.col("due_date"), now)).alias("overdue"), F.sum("percent_complete").alias("p"))
    by = projects.select("project_id", "area_id").join(by, "project_id", "left").groupBy("area_id").agg(F.count(F.lit(1)).alias("projects"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tasks", "complete", "overdue", "p")))
    out = areas.join(by, "area_id", "left").fillna(0, ["projects", "tasks", "complete", "overdue", "p"])
    return out.select("area_name", "projects", "tasks", "complete", "overdue", F.when(F.col("tasks") == 0, F.lit(0).cast("bigint")).otherwise(X.round_half_up(F.col("p") / F.col("tasks"))).alias("percent_complete"))


def parent_rollup(children: DataFrame, *more: Column) -> DataFrame:
    """A-17: percent and status of each parent from its children; columns parent_id, status, percent_complete and more, other aggregates with names."""
    s = F.col("status")
    by = children.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "Blocked").alias("b"), F.count_if(s == "Complete").alias("c"), F.count_if(X.active_status(s)).alias("a"), F.avg("percent_complete").alias("p"), *more)
    kept = by.columns[by.columns.index("p") + 1 :]
    return by.select("parent_id", X.round_half_up(F.col("p")).alias("percent_complete"), X.parent_status(F.col("n"), F.col("b"), F.col("c"), F.col("a")).alias("status"), *kept)


def pipeline_by_stage(opportunities: DataFrame) -> DataFrame:
    """A-18: every stage of the vocabulary in order; unknown stages are dropped."""
    stages = opportunities.sparkSession.createDataFrame(list(enumerate(X.PIPELINE_STAGES)), "position int, stage string")
    by = opportunities.groupBy(F.col("stage_canonical").alias("stage")).agg(F.sum(X.money("amount")).cast("double").alias("value"), F.count(F.lit(1)).alias("n"))
    return stages.join(by, "stage", "left").select("position", "stage", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def pipeline_totals(by_stage: DataFrame) -> DataFrame:
    open_ = ~F.col("stage").isin(X.CLOSED_STAGES)
    return by_stage.agg(*(F.sum(c.cast("decimal(18,2)")).cast("double").alias(a) for c, a in ((F.col("value"), "total_value"), (F.when(open_, F.col("value")).otherwise(0.0), "open_value"))), F.sum("n").alias("total_count"))


def marketing_totals(campaigns: DataFrame) -> DataFrame:
    """A-20: sums and guarded rates."""
    out = campaigns.agg(*(F.sum(c).alias(c) for c in ("sends", "opens", "clicks")), F.sum(X.money("influenced_pipeline")).cast("double").alias("influenced"))
    return out.withColumns({"open_rate": X.percent(F.col("opens"), F.col("sends")), "click_rate": X.percent(F.col("clicks"), F.col("sends"))})

