"""Composite views, merges and rules with all their rows and columns, each beside its DuckDB SQL.

The views and the catalog have shorter forms of some of them, which stay.
Each takes (spark, sf_dir) and reads whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import maintain as M
from ..operators import report as R
from ..operators import rollups as A
from ..sources import entities as E
from .catalog import day, filled, rollup_with_area
from .oracle import ASOF, BASE, KPI, NOW, SRC, share

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """sql may begin with further table expressions, after a comma."""
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {BASE} {sql}"
        return f

    return add


def shown_users(s, d) -> DataFrame:
    u = E.users(s, d)
    return u.select("user_id", "role", X.display_name(F.col("display_name"), F.col("first_name"), F.col("last_name"), F.col("email"), F.col("user_id").cast("string")).alias("shown"))


# X-1 as in the catalog's x_1_display_names.
SHOWN = """CASE WHEN trim(coalesce(display_name, '')) <> '' THEN trim(display_name) WHEN trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')) <> '' THEN trim(coalesce(first_name, '') || ' ' || coalesce(last_name, ''))
  WHEN coalesce(email, '') <> '' THEN email ELSE CAST(user_id AS VARCHAR) END"""


# --- the task and the report views ------------------------------------------------------


ROLES = {"assignee_id": "assignee", "blocked_by_id": "blocked_by", "escalated_to_id": "escalated_to", "escalated_by_id": "escalated_by", "original_assignee_id": "original_assignee", "resolved_by_id": "resolved_by"}
MORE_IDS = "CASE WHEN part_id % 4 = 0 THEN part_id % 9 + 1 END AS escalated_by_id, CASE WHEN part_id % 4 = 0 THEN part_id % 5 + 2 END AS original_assignee_id, CASE WHEN part_id % 8 = 0 THEN part_id % 7 + 1 END AS resolved_by_id"


@query(f""", x AS (SELECT *, {MORE_IDS} FROM tasks) SELECT t.project_id, line_no, part_id, code AS project_code, p.area_id, area_name, t.assignee_id, priority, t.status, percent_complete, CAST(due_date AS VARCHAR) AS due_date,
  t.blocked_by_id, t.escalated_to_id, t.escalated_by_id, t.original_assignee_id, t.resolved_by_id, CAST(escalated_at AS VARCHAR) AS escalated_at, CAST(escalation_resolved_at AS VARCHAR) AS escalation_resolved_at, CAST(completed_at AS VARCHAR) AS completed_at,
  {", ".join(f"u{k}.user_name AS {name}_name" for k, name in enumerate(ROLES.values()))},
  escalated_at IS NOT NULL AND escalation_resolved_at IS NULL AS is_escalated, t.status <> 'Complete' AND due_date < {ASOF} AS is_overdue,
  t.status <> 'Complete' AND due_date >= {ASOF} AND due_date <= {ASOF} + 7 AS is_due_soon, coalesce(t.blocked_by_id = 5, false) AND t.status = 'Blocked' AS is_blocking_viewer
  FROM x t LEFT JOIN projects p ON t.project_id = p.project_id LEFT JOIN areas a ON p.area_id = a.area_id {" ".join(f"LEFT JOIN users u{k} ON t.{c} = u{k}.user_id" for k, c in enumerate(ROLES))}""")
def p_1_whole_task(s, d):
    """P-1, J-5: a task with its project, area, six users and flags, as far as the tables have fields."""
    t = E.tasks(s, d).selectExpr("*", *MORE_IDS.split(", "))
    for c, name in ROLES.items():
        t = t.join(E.users(s, d).select(F.col("user_id").alias(c), F.col("user_name").alias(f"{name}_name")), c, "left")
    p = E.projects_with_area(s, d).join(E.focus_areas(s, d), "area_id", "left").select("project_id", F.col("code").alias("project_code"), "area_id", "area_name")
    status, due = F.col("status"), F.col("due_date")
    stamps = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("escalated_at", "escalation_resolved_at", "completed_at")]
    return t.join(p, "project_id", "left").select(
        "project_id", "line_no", "part_id", "project_code", "area_id", "area_name", "priority", "status", "percent_complete", day("due_date"), *ROLES, *stamps, *(f"{n}_name" for n in ROLES.values()),
        X.active_escalation(F.col("escalated_at"), F.col("escalation_resolved_at")).alias("is_escalated"), X.overdue(status, due, E.as_of()).alias("is_overdue"), X.due_soon(status, due, E.as_of()).alias("is_due_soon"),
        (F.coalesce(F.col("blocked_by_id") == 5, F.lit(False)) & (status == "Blocked")).alias("is_blocking_viewer"),
    )


@query(f"""SELECT a.area_id, area_name, target_numeric, current_numeric, CASE WHEN target_numeric > 0 THEN {share("current_numeric", "target_numeric")} END AS attainment, r.project_id, code, status, health, pct AS percent_complete, n AS task_count, late AS overdue_count, tasks
  FROM areas a LEFT JOIN targets USING (area_id) LEFT JOIN rollup_ r ON r.area_id = a.area_id
  LEFT JOIN (SELECT project_id, string_agg(CAST(line_no AS VARCHAR) || ' ' || CAST(part_id AS VARCHAR) || ' ' || status || ' ' || CAST(due_date AS VARCHAR) || ' ' || CAST(percent_complete AS VARCHAR), '; ' ORDER BY line_no, part_id, due_date, status, percent_complete) AS tasks FROM tasks GROUP BY 1) t ON t.project_id = r.project_id""")
def v_7_report_tree_rows(s, d):
    """V-7, J-9, V-4: areas with targets, their projects with rollups, and each project's tasks nested in order (here as text); a project's tasks are few, an area's projects are rows."""
    task = F.struct("line_no", "part_id", "due_date", "status", "percent_complete")
    nested = E.tasks(s, d).groupBy("project_id").agg(F.array_sort(F.collect_list(task)).alias("t"))
    line = F.transform("t", lambda x: F.concat_ws(" ", x["line_no"].cast("string"), x["part_id"].cast("string"), x["status"], x["due_date"].cast("string"), x["percent_complete"].cast("string")))
    nested = nested.select("project_id", F.concat_ws("; ", line).alias("tasks"))
    r = rollup_with_area(s, d).select("area_id", "project_id", "code", "status", "health", "percent_complete", "task_count", "overdue_count").join(nested, "project_id", "left")
    t = E.targets(s, d).select("area_id", "target_numeric", "current_numeric")
    areas = E.focus_areas(s, d).join(t, "area_id", "left")
    # the projects stay where they are: dealt by area they would reach as many tasks as there are areas
    empty = areas.join(E.projects_with_area(s, d).select("area_id").distinct(), "area_id", "left_anti")
    out = r.join(F.broadcast(areas), "area_id").unionByName(empty, allowMissingColumns=True)
    return out.select("area_id", "area_name", "target_numeric", "current_numeric", F.when(F.col("target_numeric") > 0, X.percent(F.col("current_numeric"), F.col("target_numeric"))).alias("attainment"), *r.columns[2:], "project_id")


@query(f"""SELECT CAST(CAST(completed_at AS DATE) AS VARCHAR) AS completed_on, code AS tactic, coalesce(area_name, '') AS initiative, {SHOWN} AS assignee, role, 'line ' || line_no || ' of part ' || part_id AS description, priority, CAST(due_date AS VARCHAR) AS due_date,
  CASE WHEN k <= 0 THEN CAST(-k AS VARCHAR) || ' early' ELSE CAST(k AS VARCHAR) || ' late' END AS vs_due, t.project_id
  FROM (SELECT *, CAST(floor((epoch_us(completed_at) - epoch_us(CAST(due_date AS TIMESTAMP))) / 86400e6 + 0.5) AS BIGINT) AS k FROM tasks WHERE status = 'Complete' AND completed_at >= {NOW} - INTERVAL 30 DAY) t
  LEFT JOIN projects p ON p.project_id = t.project_id LEFT JOIN areas a ON a.area_id = p.area_id LEFT JOIN users ON user_id = assignee_id""")
def v_16_completed_sheet_rows(s, d):
    """V-16: ten columns; the tables have no project names, so the project's id stands for one."""
    t = E.tasks(s, d).where((F.col("status") == "Complete") & (F.col("completed_at") >= E.now() - F.expr("INTERVAL 30 DAYS")))
    p = E.projects_with_area(s, d).join(E.focus_areas(s, d), "area_id", "left").select("project_id", F.col("code").alias("tactic"), F.coalesce("area_name", F.lit("")).alias("initiative"))
    u = shown_users(s, d).withColumnsRenamed({"user_id": "assignee_id", "shown": "assignee"})
    return t.join(p, "project_id", "left").join(u, "assignee_id", "left").select(
        F.to_date("completed_at").cast("string").alias("completed_on"), "tactic", "initiative", "assignee", "role", F.concat(F.lit("line "), "line_no", F.lit(" of part "), "part_id").alias("description"), "priority", day("due_date"),
        X.days_vs_due(F.col("completed_at"), F.col("due_date")).alias("vs_due"), "project_id",
    )


WEEK_SUMS = ", ".join(f"CAST(sum(count) FILTER (period_start = DATE '2024-01-22' - {7 * (5 - k)}) AS BIGINT) AS week_{k + 1}" for k in range(6))


@query(f""", w AS (SELECT metric, CAST(user_id AS VARCHAR) AS developer, any_value(target) AS target, {WEEK_SUMS}, CAST(sum(count) AS BIGINT) AS total FROM filled GROUP BY metric, user_id
  UNION ALL SELECT metric, 'TEAM TOTAL', any_value(target) * count(DISTINCT user_id), {WEEK_SUMS}, CAST(sum(count) AS BIGINT) FROM filled GROUP BY metric)
  SELECT *, target * 6 AS total_target, CASE WHEN target <> 0 THEN total / (target * 6) ELSE 0 END AS share FROM w""")
def v_17_weekly_sheet_rows(s, d):
    """V-17: metric, developer, target, six weeks from the oldest, total, target of six weeks and share, with a TEAM TOTAL row for each metric."""
    back = (F.datediff(X.monday(E.kpi_now()), F.col("period_start")) / 7).cast("int")
    weeks = [F.sum(F.when(back == 5 - k, F.col("count"))).alias(f"week_{k + 1}") for k in range(6)]
    each = filled(s, d).groupBy("metric", "user_id").agg(F.any_value("target").alias("target"), *weeks, F.sum("count").alias("total"))
    names = [f"week_{k + 1}" for k in range(6)] + ["total"]
    team = each.groupBy("metric").agg(F.sum("target").alias("target"), *(F.sum(c).alias(c) for c in names))
    both = each.withColumn("developer", F.col("user_id").cast("string")).drop("user_id").unionByName(team.withColumn("developer", F.lit("TEAM TOTAL")))
    all_ = F.col("target") * 6
    return both.withColumns({"total_target": all_, "share": F.when(all_ != 0, F.col("total") / all_).otherwise(0.0)})


COVER = ["Strategic Initiatives", "Active Tactics", "Tactics on Track", "Portfolio Avg Completion", "Total Tasks", "Tasks Complete", "Tasks Overdue", "Tasks Blocked", "Tasks Completed (Last 30 Days)"]


@query(f""", c AS (SELECT count(*) AS p, count(*) FILTER (n > 0) AS active, count(*) FILTER (health = 'green') AS green, CAST(floor(avg(pct) + 0.5) AS BIGINT) AS pct, CAST(sum(n) AS BIGINT) AS t, CAST(sum(c) AS BIGINT) AS done, CAST(sum(late) AS BIGINT) AS late, CAST(sum(b) AS BIGINT) AS b FROM rollup_)
  SELECT unnest({COVER}) AS label, unnest([CAST((SELECT count(*) FROM areas) AS VARCHAR), active || ' of ' || p, green || ' of ' || p, pct || '%', CAST(t AS VARCHAR), CAST(done AS VARCHAR), CAST(late AS VARCHAR), CAST(b AS VARCHAR),
  CAST((SELECT count(*) FROM tasks WHERE status = 'Complete' AND completed_at >= {NOW} - INTERVAL 30 DAY) AS VARCHAR)]) AS value FROM c""")
def v_18_cover_sheet_rows(s, d):
    """V-18: nine labels with their values."""
    r = A.project_rollup(E.projects(s, d), E.tasks(s, d), E.as_of())
    n, text = F.count(F.lit(1)), lambda c: c.cast("string")
    of = lambda cond: F.concat(text(F.count_if(cond)), F.lit(" of "), text(n))
    one = r.agg(
        of(F.col("task_count") > 0).alias("v1"), of(F.col("health") == "green").alias("v2"), F.concat(text(F.coalesce(X.round_half_up(F.avg("percent_complete")), F.lit(0))), F.lit("%")).alias("v3"),
        *(text(F.sum(c)).alias(f"v{k}") for k, c in enumerate(("task_count", "complete_count", "overdue_count", "blocked_count"), 4)),
    )
    areas = E.focus_areas(s, d).agg(text(n).alias("v0"))
    recent = E.tasks(s, d).agg(text(F.count_if((F.col("status") == "Complete") & (F.col("completed_at") >= E.now() - F.expr("INTERVAL 30 DAYS")))).alias("v8"))
    pairs = F.array(*(F.struct(F.lit(label).alias("label"), F.col(f"v{k}").alias("value")) for k, label in enumerate(COVER)))
    return one.crossJoin(areas).crossJoin(recent).select(F.explode(pairs).alias("x")).select("x.*")  # one row each


@query("SELECT metric, user_id, CAST(period_start AS VARCHAR) AS period_start, old_count, new_count FROM audit WHERE old_count IS NULL OR old_count <> new_count")
def v_12_history(s, d):
    """All changes, newest first."""
    return M.kpi_audit(E.metric_entries(s, d)).select("metric", "user_id", day("period_start"), "old_count", "new_count").orderBy(F.col("period_start").desc(), "metric", "user_id")


@query(f"SELECT user_id, role, {SHOWN} AS shown FROM users")
def v_29_users_sorted(s, d):
    """Users by shown name, in the order of a locale."""
    return shown_users(s, d).orderBy(F.collate("shown", "UNICODE"), "user_id")


@query("SELECT metric, CAST(sum(count) AS BIGINT) AS done, CAST(sum(target) AS BIGINT) AS target, count(*) FILTER (count >= target) AS on_target, count(*) AS people, CASE WHEN sum(target) <> 0 THEN CAST(floor(sum(count) * 100 / sum(target) + 0.5) AS BIGINT) END AS percent FROM current GROUP BY 1")
def v_19_scorecard_rows(s, d):
    """V-19, K-5: the board brief's figures of the week by metric."""
    c = filled(s, d).where(F.col("period_start") == X.monday(E.kpi_now()))
    by = c.groupBy("metric").agg(F.sum("count").alias("done"), F.sum("target").alias("target"), F.count_if(F.col("count") >= F.col("target")).alias("on_target"), F.count(F.lit(1)).alias("people"))
    return by.withColumn("percent", X.percent(F.col("done"), F.col("target")))


@query(f""", owner AS (SELECT area_id, owner_id FROM projects GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY area_id ORDER BY count(*) DESC, owner_id) = 1)
  SELECT a.area_id, area_name AS name, coalesce(c_name, '') AS owner, CASE WHEN tactics = 0 THEN 'No Tasks' WHEN complete = tactics THEN 'Complete' WHEN red > 0 THEN 'Blocked' WHEN amber > 0 THEN 'At Risk' ELSE 'On Track' END AS status,
  current_numeric AS current, target_numeric AS target, CASE WHEN target_numeric > 0 THEN {share("current_numeric", "target_numeric")} END AS attainment, tactics, on_track, coalesce({share("on_track", "tactics")}, 0) AS on_track_percent, tasks, overdue, pct AS average
  FROM (SELECT a.area_id, area_name, count(project_id) AS tactics, count(*) FILTER (health = 'green') AS on_track, count(*) FILTER (health = 'red') AS red, count(*) FILTER (health = 'amber') AS amber, count(*) FILTER (status = 'Complete') AS complete,
    CAST(coalesce(sum(n), 0) AS BIGINT) AS tasks, CAST(coalesce(sum(late), 0) AS BIGINT) AS overdue, coalesce(CAST(floor(avg(pct) + 0.5) AS BIGINT), 0) AS pct FROM areas a LEFT JOIN rollup_ r ON a.area_id = r.area_id GROUP BY 1, 2) a
  LEFT JOIN targets t ON t.area_id = a.area_id LEFT JOIN owner o ON o.area_id = a.area_id LEFT JOIN customer ON c_custkey = o.owner_id""")
def v_14_initiatives_sheet(s, d):
    """V-14: the sheet's columns with each initiative's most common owner; the tables have no goals or units."""
    r = rollup_with_area(s, d)
    names = E.owners(s, d).select("owner_id", "owner_name")
    owner = A.top_owner(r).join(names, "owner_id", "left").select("area_id", "owner_name")
    t = E.targets(s, d).select("area_id", F.col("current_numeric").alias("current"), F.col("target_numeric").alias("target"))
    out = A.initiatives(E.focus_areas(s, d), r, E.targets(s, d)).join(owner, "area_id", "left").join(t, "area_id", "left")
    return out.select("area_id", F.col("area_name").alias("name"), F.coalesce("owner_name", F.lit("")).alias("owner"), "status", "current", "target", "attainment", "tactics", "on_track", "on_track_percent", "tasks", "overdue", F.col("percent_complete").alias("average"))


@query(f""", v AS (SELECT 'focusAreas' AS section, CAST(area_id AS VARCHAR) AS key, CAST(CASE WHEN sum(n) > 0 THEN CAST(floor(sum(s) / sum(n) + 0.5) AS BIGINT) ELSE 0 END AS VARCHAR) AS value FROM areas LEFT JOIN r1 USING (area_id) GROUP BY area_id
  UNION ALL SELECT 'workload', CAST(user_id AS VARCHAR), total || ' tasks, ' || open || ' open, ' || overdue || ' overdue' FROM work
  UNION ALL SELECT 'taskBreakdown', status, CAST(count(*) AS VARCHAR) FROM tasks GROUP BY status UNION ALL SELECT 'taskBreakdown', priority, CAST(count(*) AS VARCHAR) FROM tasks GROUP BY priority
  UNION ALL SELECT 'needsAttention', project_id || '/' || line_no || '/' || part_id, CASE WHEN status <> 'Complete' AND due_date < {ASOF} THEN 'Overdue' ELSE 'Blocked' END FROM tasks WHERE status = 'Blocked' OR (status <> 'Complete' AND due_date < {ASOF})
  UNION ALL SELECT 'kpis', unnest(['active_projects', 'total_tasks', 'overdue_tasks', 'blocked_tasks']), CAST(unnest([count(*) FILTER (n > 0), CAST(sum(n) AS BIGINT), CAST(sum(late) AS BIGINT), CAST(sum(b) AS BIGINT)]) AS VARCHAR) FROM rollup_)
  SELECT * FROM v""")
def v_1_dashboard_rows(s, d):
    """V-1: all five sections with their rows, as section, key and value."""
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    part = lambda name, df, key, value: df.select(F.lit(name).alias("section"), text(key).alias("key"), text(value).alias("value"))
    r, t = rollup_with_area(s, d), E.tasks(s, d)
    late = X.overdue(F.col("status"), F.col("due_date"), E.as_of())
    kpis = ["active_projects", "total_tasks", "overdue_tasks", "blocked_tasks"]
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).cast("bigint").alias("v")) for k in kpis))
    counted = t.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"))  # few rows, counted twice below
    parts = [
        part("kpis", A.portfolio(r).select(F.explode(pairs).alias("x")), F.col("x.k"), F.col("x.v")),
        part("focusAreas", A.area_rollup(E.focus_areas(s, d), r), "area_id", "percent_complete"),
        part("workload", A.workload(E.users(s, d), t, E.as_of()), "user_id", F.concat("total", F.lit(" tasks, "), "open", F.lit(" open, "), "overdue", F.lit(" overdue"))),
        *(part("taskBreakdown", counted.groupBy(c).agg(F.sum("n").alias("n")), c, "n") for c in ("status", "priority")),
        part("needsAttention", t.where(late | (F.col("status") == "Blocked")), F.concat_ws("/", text("project_id"), text("line_no"), text("part_id")), F.when(late, "Overdue").otherwise("Blocked")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(f"SELECT source_system, status, id AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS sent_at FROM (SELECT ({SRC})[event_id % 2 + 1] AS source_system, 'connected' AS status, event_id AS id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 2 ORDER BY ts DESC, event_id DESC) <= 10)")
def v_23_connection_cards(s, d):
    """V-23, S-11: each source's card with its ten newest events."""
    cards = [E.connection_card(E.connections(s), E.email_activity(s, d), x) for x in E.SOURCES]
    return reduce(DataFrame.unionByName, cards).select("source_system", "status", "event_id", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent_at"))


@query(f"SELECT source, object, n FROM (SELECT source_system AS source, 'opportunities' AS object, count(*) AS n FROM opps GROUP BY 1 UNION ALL SELECT source_system, 'campaigns', count(*) FROM camps GROUP BY 1 UNION ALL SELECT ({SRC})[event_id % 2 + 1], 'email_activity', count(*) FROM events GROUP BY 1 UNION ALL SELECT source_system, 'one opportunity', count(*) FROM opps WHERE id = 7 GROUP BY 1)")
def s_11_all_lists(s, d):
    """Every list of every adapter, and one record."""
    parts = [df.select(F.lit(src).alias("source"), F.lit(name).alias("object")) for src in E.SOURCES for name, df in E.adapter(s, d, src).items()]
    parts += [E.source_record(E.opportunities(s, d), src, 7).select(F.lit(src).alias("source"), F.lit("one opportunity").alias("object")) for src in E.SOURCES]
    return reduce(DataFrame.unionByName, parts).groupBy("source", "object").agg(F.count(F.lit(1)).alias("n"))


# --- report catalogue and scalars --------------------------------------------------------


#: What a report may group by and sum, by source.
CATALOGUE = {
    "opportunities": (["stageCanonical", "sourceSystem", "ownerName"], ["amount"]),
    "campaigns": (["channel", "type", "status", "sourceSystem"], ["sends", "opens", "clicks", "influencedPipeline"]),
    "accounts": (["type", "region", "ownerName", "sourceSystem"], []),
    "people": (["title", "ownerName", "sourceSystem"], []),
    "email_activity": (["sourceSystem"], ["sends", "opens", "clicks"]),
    "tasks": (["status", "priority", "assigneeName", "projectName"], ["percentComplete"]),
}


DIMENSIONS = ["status", "priority", "assignee_id", "blocked_by_id"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS dimension, '{a}' AS agg, coalesce(CAST({c} AS VARCHAR), '—') AS dim, floor({e} * 100 + 0.5) / 100 AS value FROM tasks GROUP BY {c}" for c in DIMENSIONS for a, e in (("count", "CAST(count(*) AS DOUBLE)"), ("sum", "CAST(sum(percent_complete) AS DOUBLE)"), ("avg", "avg(percent_complete)"))))
def a_34_task_reports(s, d):
    """Every dimension with every aggregate, null as a dash, two decimals: one scan, a grouping set for each dimension."""
    specs = {c: R.Spec(["tasks"], [R.Metric("count"), R.Metric("sum", "percent_complete"), R.Metric("avg", "percent_complete")], [c]) for c in DIMENSIONS}
    out = R.run_reports({"tasks": E.tasks(s, d)}, specs).select(F.col("report").alias("dimension"), F.coalesce(F.get("dims", F.lit(0)), F.lit("—")).alias("dim"), F.posexplode("metrics").alias("k", "v"))
    return out.select("dimension", E.pick(["count", "sum", "avg"], F.col("k")).alias("agg"), "dim", X.round2(F.col("v")).alias("value"))


@query(f""", f AS (SELECT user_id, CAST(floor((epoch({KPI}) - floor(epoch(max(ts)))) / 60) AS BIGINT) AS m FROM events WHERE ts <= {KPI} GROUP BY 1)
  SELECT user_id, CASE WHEN m < 1 THEN 'synced less than a minute ago' ELSE 'synced ' || n || ' ' || unit || CASE WHEN n = 1 THEN '' ELSE 's' END || ' ago' END AS freshness
  FROM (SELECT *, CASE WHEN m < 60 THEN m WHEN m < 1440 THEN m // 60 WHEN m < 43200 THEN m // 1440 ELSE m // 43200 END AS n, CASE WHEN m < 60 THEN 'minute' WHEN m < 1440 THEN 'hour' WHEN m < 43200 THEN 'day' ELSE 'month' END AS unit FROM f)""")
def x_27_freshness(s, d):
    e = E.events(s, d).select("user_id", F.col("ts").cast("timestamp").alias("at")).where(F.col("at") <= E.kpi_now()).groupBy("user_id").agg(F.max("at").alias("at"))
    return e.select("user_id", X.freshness(F.col("at"), E.kpi_now()).alias("freshness"))


@query("SELECT metric, user_id, CAST(period_start AS VARCHAR) AS period_start, count / greatest(max(count) OVER (PARTITION BY metric, user_id), target, 1) AS height FROM filled")
def x_28_spark_heights(s, d):
    by = filled(s, d).groupBy("metric", "user_id").agg(F.any_value("target").alias("target"), F.array_sort(F.collect_list(F.struct("period_start", "count"))).alias("x"))
    heights = X.spark_heights(F.transform("x", lambda e: e["count"]), F.col("target"))
    return by.select("metric", "user_id", F.explode(F.arrays_zip(F.transform("x", lambda e: e["period_start"]).alias("p"), heights.alias("h"))).alias("z")).select("metric", "user_id", F.col("z.p").cast("string").alias("period_start"), F.col("z.h").alias("height"))


# --- merges, escalations, entries ---------------------------------------------------------


SOURCE, TARGET = 4, 5


def merged(s, d) -> dict[str, DataFrame]:
    """User 4 becomes user 5, who has no address."""
    tasks, requests = E.tasks(s, d), E.access_requests(s, d)
    members = tasks.select(F.col("project_id").alias("group_id"), F.col("assignee_id").alias("user_id")).distinct()
    entries = E.metric_entries(s, d).select("metric", "user_id", "period_start", "count")
    referring = {"tasks": (tasks, ["assignee_id", "blocked_by_id", "escalated_to_id"]), "requests": (requests, ["requester_user_id", "decided_by_id"]), "invitations": (E.invitations(s, d), ["target_user_id"]), "targets": (E.targets(s, d), ["updated_by_id"])}
    keyed = {"members": (members, "user_id", ["group_id"]), "entries": (entries, "user_id", ["metric", "period_start"])}
    return M.merge_users(E.users(s, d), SOURCE, TARGET, referring, keyed, ["email", "display_name"])


@query("SELECT user_id, CASE WHEN user_id = 4 THEN NULL WHEN user_id = 5 THEN coalesce(nullif(email, ''), (SELECT email FROM users WHERE user_id = 4)) ELSE email END AS email, CASE WHEN user_id = 4 THEN false WHEN user_id = 5 THEN true ELSE is_active END AS is_active FROM users")
def m_1_merged_accounts(s, d):
    return merged(s, d)["users"].select("user_id", "email", "is_active")


@query(""", members AS (SELECT DISTINCT project_id AS group_id, assignee_id AS user_id FROM tasks), requests AS (SELECT user_id AS requester_user_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS decided_by_id FROM events)
  SELECT * FROM (SELECT 'tasks.assignee_id' AS column_name, count(*) AS moved FROM tasks WHERE assignee_id = 4 UNION ALL SELECT 'tasks.blocked_by_id', count(*) FROM tasks WHERE blocked_by_id = 4 UNION ALL SELECT 'tasks.escalated_to_id', count(*) FROM tasks WHERE escalated_to_id = 4
  UNION ALL SELECT 'requests.requester_user_id', count(*) FROM requests WHERE requester_user_id = 4 UNION ALL SELECT 'requests.decided_by_id', count(*) FROM requests WHERE decided_by_id = 4 UNION ALL SELECT 'invitations.target_user_id', count(*) FROM events WHERE user_id = 4
  UNION ALL SELECT 'targets.updated_by_id', count(*) FROM targets WHERE updated_by_id = 4 UNION ALL SELECT 'members.user_id', count(*) FROM members WHERE user_id = 4 AND group_id NOT IN (SELECT group_id FROM members WHERE user_id = 5)
  UNION ALL SELECT 'entries.user_id', count(*) FROM entries x WHERE user_id = 4 AND NOT EXISTS (SELECT 1 FROM entries y WHERE y.user_id = 5 AND y.metric = x.metric AND y.period_start = x.period_start)) WHERE moved > 0""")
def m_1_merged_counts(s, d):
    return merged(s, d)["moved"]


@query("SELECT project_id, line_no, part_id, CASE WHEN assignee_id = 4 THEN 5 ELSE assignee_id END AS assignee_id, CASE WHEN blocked_by_id = 4 THEN 5 ELSE blocked_by_id END AS blocked_by_id, CASE WHEN escalated_to_id = 4 THEN 5 ELSE escalated_to_id END AS escalated_to_id FROM tasks")
def m_1_merged_tasks(s, d):
    return merged(s, d)["tasks"].select("project_id", "line_no", "part_id", "assignee_id", "blocked_by_id", "escalated_to_id")


@query("SELECT metric, CASE WHEN user_id = 4 THEN 5 ELSE user_id END AS user_id, CAST(period_start AS VARCHAR) AS period_start, count FROM entries x WHERE user_id <> 4 OR NOT EXISTS (SELECT 1 FROM entries y WHERE y.user_id = 5 AND y.metric = x.metric AND y.period_start = x.period_start)")
def m_1_merged_entries(s, d):
    return merged(s, d)["entries"].select("metric", "user_id", day("period_start"), "count")


@query(f""", u AS (SELECT * REPLACE (CASE WHEN project_id % 10 = 0 AND status <> 'Complete' THEN {ASOF} ELSE due_date END AS due_date) FROM tasks)
  SELECT project_id, count(*) AS tasks, count(*) FILTER (status <> 'Complete' AND due_date < {ASOF}) AS overdue, count(*) FILTER (due_date = {ASOF}) AS due_now, CAST(floor(sum(percent_complete) / count(*) + 0.5) AS BIGINT) AS percent_complete FROM u GROUP BY 1""")
def m_3_propagated(s, d):
    """A parent's due date reaches its open children; the parents are counted anew."""
    t = M.propagate(E.tasks(s, d), F.col("project_id") % 10 == 0, due_date=E.as_of())
    by = A.task_counts(t.withColumn("now_", F.col("due_date") == E.as_of()), ["project_id"], E.as_of())
    now_ = t.groupBy("project_id").agg(F.count_if(F.col("due_date") == E.as_of()).alias("due_now"))
    return by.join(now_, "project_id").select("project_id", F.col("task_count").alias("tasks"), F.col("overdue_count").alias("overdue"), "due_now", X.round_half_up(F.col("percent_sum") / F.col("task_count")).alias("percent_complete"))


@query(f"""SELECT project_id, line_no, part_id, CASE WHEN r THEN 'Blocked' ELSE status END AS status, CASE WHEN r THEN 3 ELSE escalated_to_id END AS escalated_to_id, CASE WHEN r THEN 3 ELSE blocked_by_id END AS blocked_by_id, CASE WHEN r THEN CAST(6 AS BIGINT) END AS escalated_by_id,
  CASE WHEN r THEN assignee_id END AS original_assignee_id, CASE WHEN r THEN 'stuck' END AS block_notes, CASE WHEN r THEN true ELSE escalated_at IS NOT NULL AND escalation_resolved_at IS NULL END AS is_escalated FROM (SELECT *, status = 'In Progress' AND part_id % 5 = 0 AS r FROM tasks)""")
def m_4_raised(s, d):
    """Tasks in progress that user 6 raises to user 3."""
    t = M.raise_escalations(E.tasks(s, d), (F.col("status") == "In Progress") & (F.col("part_id") % 5 == 0), 3, 6, "stuck", E.now())
    return t.select("project_id", "line_no", "part_id", "status", "escalated_to_id", "blocked_by_id", "escalated_by_id", "original_assignee_id", "block_notes", X.active_escalation(F.col("escalated_at"), F.col("escalation_resolved_at")).alias("is_escalated"))


ASKED = "SELECT metric, user_id, period_start, count AS old_count, user_id + CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END AS actor_id, (['member', 'lead', 'admin', 'vp', 'super_admin', 'observer'])[user_id % 6 + 1] AS actor_role, count + user_id % 3 - 1 AS count, CASE WHEN user_id % 5 <> 0 THEN 'note' WHEN user_id % 2 = 0 THEN ' ' END AS note FROM entries"
VERDICTS = f"""(SELECT *, CASE WHEN actor_role = 'member' AND actor_id <> user_id THEN 'own only' WHEN period_start < DATE '2024-01-22' AND period_start <> DATE '2024-01-08' AND actor_role NOT IN ('vp', 'admin') THEN 'locked'
  WHEN count > old_count AND trim(coalesce(note, '')) = '' THEN 'evidence' ELSE 'written' END AS verdict FROM ({ASKED}))"""


def upserted(s, d):
    e = E.metric_entries(s, d).select("metric", "user_id", "period_start", "count").withColumn("note", F.when(F.col("count") > 1, "old"))
    user = F.col("user_id")
    asked = e.select("metric", "user_id", "period_start", (user + F.when(user % 4 == 0, 1).otherwise(0)).alias("actor_id"), E.pick(E.ROLES, user % 6).alias("actor_role"), (F.col("count") + user % 3 - 1).alias("count"), F.when(user % 5 != 0, "note").when(user % 2 == 0, " ").alias("note"))
    over = s.createDataFrame([("2024-01-08",)], "p string").select(F.to_date("p").alias("period_start"))
    return M.kpi_upsert(e, asked, over, E.kpi_now())


@query(f"SELECT metric, user_id, CAST(period_start AS VARCHAR) AS period_start, old_count, count, verdict FROM {VERDICTS}")
def m_6_verdicts(s, d):
    return upserted(s, d)[0].select("metric", "user_id", day("period_start"), "old_count", "count", "verdict")


@query(f"SELECT metric, user_id, CAST(period_start AS VARCHAR) AS period_start, CASE WHEN verdict = 'written' THEN count ELSE old_count END AS count, CASE WHEN verdict = 'written' AND trim(coalesce(note, '')) <> '' THEN note WHEN old_count > 1 THEN 'old' END AS note FROM {VERDICTS}")
def m_6_entries(s, d):
    return upserted(s, d)[1].select("metric", "user_id", day("period_start"), "count", "note")


@query(f"SELECT metric, user_id, CAST(period_start AS VARCHAR) AS period_start, old_count, count AS new_count, nullif(trim(note), '') AS note, actor_id AS changed_by_id FROM {VERDICTS} WHERE verdict = 'written' AND (old_count <> count OR trim(coalesce(note, '')) <> '')")
def m_6_audit(s, d):
    return upserted(s, d)[2].select("metric", "user_id", day("period_start"), "old_count", "new_count", "note", "changed_by_id")


@query("SELECT user_id, false AS is_group_parent, url FROM users, (VALUES ('a'), ('b')) v(url) WHERE user_id % 5 = 2 UNION ALL SELECT 3, true, url FROM (VALUES ('a'), ('b')) v(url)")
def m_2_group_links(s, d):
    """A parent task of user 3 and one for each member of a group, with both links on each."""
    return M.bulk_assign_group(E.group_members(s, d).where("group_id = 2"), 3, s.createDataFrame([("a",), ("b",)], "url string"), "do it", E.as_of())[1]


@query("SELECT 'Not Started' AS status, CAST(0 AS BIGINT) AS percent_complete, count(*) AS children FROM users WHERE user_id % 5 = 2")
def m_2_parent_rollup(s, d):
    tasks, _ = M.bulk_assign_group(E.group_members(s, d).where("group_id = 2"), 3, s.createDataFrame([("a",)], "url string"), "do it", E.as_of())
    children = tasks.where("NOT is_group_parent").withColumn("parent_id", F.lit(1))
    n = children.groupBy("parent_id").agg(F.count(F.lit(1)).alias("children"))
    return A.parent_rollup(children).join(n, "parent_id").select("status", "percent_complete", "children")


def synced(s, d):
    bare = lambda df: df.select("id", "source_system", F.lit(None).cast("timestamp").alias("synced_at"))
    tables = {"opportunities": E.opportunities(s, d), "campaigns": E.campaigns(s, d), "email_activity": E.email_activity(s, d), "accounts": E.accounts(s, d), "people": E.people(s, d)}
    return M.refresh({k: bare(v) for k, v in tables.items()}, "hubspot", E.now(), ("opportunities", "campaigns", "email_activity"))


@query(f"""SELECT 'opportunities' AS object, source_system, count(*) AS n, count(*) FILTER (source_system = 'hubspot') AS synced FROM opps GROUP BY ALL UNION ALL SELECT 'campaigns', source_system, count(*), count(*) FILTER (source_system = 'hubspot') FROM camps GROUP BY ALL
  UNION ALL SELECT 'email_activity', ({SRC})[event_id % 2 + 1] AS source_system, count(*), count(*) FILTER (event_id % 2 = 1) FROM events GROUP BY ALL UNION ALL SELECT 'accounts', source_system, count(*), count(*) FILTER (source_system = 'hubspot') FROM accounts GROUP BY ALL
  UNION ALL SELECT 'people', source_system, count(*), count(*) FILTER (source_system = 'hubspot') FROM accounts GROUP BY ALL""")
def m_5_five_tables(s, d):
    out, _ = synced(s, d)
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("object"), "source_system", "synced_at") for k, df in out.items()]).groupBy("object", "source_system").agg(F.count(F.lit(1)).alias("n"), F.count("synced_at").alias("synced"))


@query("SELECT 'hubspot' AS source_system, 'success' AS status, (SELECT count(*) FROM opps WHERE source_system = 'hubspot') + (SELECT count(*) FROM camps WHERE source_system = 'hubspot') + (SELECT count(*) FROM events WHERE event_id % 2 = 1) AS records_synced, '1998-06-01 12:00:00' AS finished_at")
def m_5_event(s, d):
    """The event's count leaves accounts and people out."""
    return synced(s, d)[1].withColumn("finished_at", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss"))


ROLE_OF = "(['member', 'lead', 'admin', 'vp', 'super_admin', 'observer'])"
DECIDED = f"(SELECT event_id AS id, user_id AS requester_user_id, event_id % 2 = 1 AS access, event_id % 3 = 0 AS pending, event_id % 5 <> 0 AS yes, {ROLE_OF}[event_id % 6 + 1] AS requested_role FROM events)"


def decided(s, d):
    r = E.access_requests(s, d).withColumn("requested_role", E.pick(E.ROLES, F.col("id") % 6))
    return M.decide_requests(r, E.users(s, d).select("user_id", "role"), F.col("id") % 5 != 0, 3, E.kpi_now())


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 5 <> 0 THEN 'approved' ELSE 'denied' END WHEN 1 THEN 'approved' ELSE 'denied' END AS status, CASE WHEN event_id % 3 = 0 THEN 3 ELSE user_id END AS decided_by_id FROM events")
def m_10_requests(s, d):
    return decided(s, d)[0].select("id", "status", "decided_by_id")


@query(f", a AS (SELECT requester_user_id AS user_id, arg_max(requested_role, id) AS raised FROM {DECIDED} WHERE pending AND yes AND access GROUP BY 1) SELECT u.user_id, coalesce(raised, role) AS role FROM users u LEFT JOIN a USING (user_id)")
def m_10_raised_roles(s, d):
    return decided(s, d)[1]


@query(f"SELECT id AS request_id, requested_role AS role, 'pending' AS status, '2024-01-31 12:00:00' AS expires_at FROM {DECIDED} WHERE pending AND yes AND NOT access")
def m_10_invitations(s, d):
    return decided(s, d)[2].withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss"))


@query(f""", i AS (SELECT event_id AS id, user_id AS target, (['pending', 'accepted', 'revoked'])[event_id % 3 + 1] AS status, ts + INTERVAL 7 DAY AS expires_at, CASE WHEN event_id % 4 <> 0 THEN 'user' || (event_id % 40) || '@example.com' END AS email FROM events),
  m AS (SELECT lower(email) AS mail, min(user_id) AS user_id FROM users WHERE email IS NOT NULL GROUP BY 1),
  x AS (SELECT i.id, i.status, status = 'pending' AND expires_at > {KPI} AS live, coalesce(t.user_id, m.user_id) AS claimed FROM i LEFT JOIN users t ON t.user_id = i.target AND i.target % 2 = 0 LEFT JOIN m ON m.mail = i.email),
  o AS (SELECT id, status, claimed, CASE WHEN NOT live THEN 'invalid' WHEN claimed IS NULL THEN 'insert' WHEN claimed % 3 = 0 THEN 'already claimed' ELSE 'claim' END AS outcome FROM x)
  SELECT id, outcome, CASE WHEN outcome = 'claim' THEN claimed END AS user_id, CASE WHEN outcome IN ('claim', 'insert') THEN 'accepted' ELSE status END AS status FROM o""")
def m_12_outcomes(s, d):
    """Odd targets are unknown; each third user has a login."""
    i = E.invitations(s, d).withColumn("target_user_id", F.when(F.col("target_user_id") % 2 == 0, F.col("target_user_id")))
    return M.accept_invitations(i, E.users(s, d).select("user_id", "email", (F.col("user_id") % 3 == 0).alias("has_login")), E.kpi_now())


@query("SELECT e.event_id AS task_id, 'Follow up' AS description, 'Not Started' AS status, 'opportunity' AS record_type, e.event_id * 3 AS record_id FROM events e JOIN opps ON id = e.event_id * 3")
def m_8_tasks_and_links(s, d):
    """Tasks made for records that exist, with their links."""
    asked = E.events(s, d).select(F.col("event_id").alias("task_id"), (F.col("event_id") * 3).alias("record_id"))
    found = asked.join(E.opportunities(s, d).select(F.col("id").alias("record_id")), "record_id", "left_semi")
    return found.select("task_id", F.lit("Follow up").alias("description"), F.lit("Not Started").alias("status"), F.lit("opportunity").alias("record_type"), "record_id")


# --- schemas ----------------------------------------------------------------------------------


#: What the sources declare of the tables.
DECLARED = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def scanned(s, d) -> DataFrame:
    """S-14: the columns of all declared tables from their files' schemas; no data is read."""
    found = [(t, i, f.name, f.dataType.simpleString()) for t in DECLARED for i, f in enumerate(E.table(s, d, t).schema)]
    return s.createDataFrame(found, "table_name string, position int, column_name string, type string")


COLUMNS = [(t, i, *c.split(" ")) for t, ddl in DECLARED.items() for i, c in enumerate(ddl.split(", "))]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i}, '{c}', '{k}')" for t, i, c, k in COLUMNS) + ") v(table_name, position, column_name, type)")
def s_14_all_tables(s, d):
    return scanned(s, d)


@query("SELECT * FROM (VALUES ('events', 'props', 'json', 'string', 'type'), ('orders', 'o_comment', 'string', NULL, 'missing'), ('part', 'p_size', NULL, 'int', 'unexpected')) v(table_name, column_name, expected, live, problem)")
def j_23_live_drift(s, d):
    """The scanned schemas against a declaration with three differences: of everything else there is no drift."""
    changed = [(t, c, "json" if c == "props" else k) for t, _, c, k in COLUMNS if c != "p_size"] + [("orders", "o_comment", "string")]
    return M.drift(s.createDataFrame(changed, "table_name string, column_name string, type string"), scanned(s, d).drop("position"))


@query("SELECT * FROM (VALUES ('missing', 1), ('type', 1), ('unexpected', 1), ('missing table', 1), ('unexpected table', 1)) v(problem, n)".replace('SELECT * FROM', 'SELECT problem, CAST(n AS BIGINT) AS n FROM'))
def v_30_live_summary(s, d):
    """V-30 over the scanned schemas: columns that one side lacks or types otherwise, and tables that one side lacks."""
    changed = [(t, c, "json" if c == "props" else k) for t, _, c, k in COLUMNS if c != "p_size" and t != "region"] + [("orders", "o_comment", "string"), ("targets", "area_id", "int")]
    declared, live = s.createDataFrame(changed, "table_name string, column_name string, type string"), scanned(s, d).drop("position")
    names = lambda df: df.select("table_name").distinct()
    both = names(declared).join(names(live), "table_name")
    columns = M.drift(declared.join(both, "table_name", "left_semi"), live.join(both, "table_name", "left_semi")).select("problem")
    lacking = names(declared).join(names(live), "table_name", "left_anti").select(F.lit("missing table").alias("problem"))
    extra = names(live).join(names(declared), "table_name", "left_anti").select(F.lit("unexpected table").alias("problem"))
    return columns.unionByName(lacking).unionByName(extra).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# --- permissions, definitions, project detail ---------------------------------------------


#: Roles with their permissions where no rows are held. admin and vp have all but impersonation.
ALL_KEYS = [
    "impersonate_users", "manage_users", "manage_permissions", "view_audit_log", "manage_access_requests", "manage_invitations", "manage_groups", "assign_tasks",
    "approve_completion", "edit_initiatives", "delete_initiatives", "manage_targets", "view_reports", "run_reports", "manage_metrics", "manage_integrations",
]
ROLE_DEFAULTS = {
    "member": [],
    "lead": ["edit_initiatives", "assign_tasks", "approve_completion", "view_reports", "manage_integrations"],
    "admin": [k for k in ALL_KEYS if k != "impersonate_users"],
    "vp": [k for k in ALL_KEYS if k != "impersonate_users"],
    "super_admin": ALL_KEYS,
    "observer": ["view_reports", "run_reports", "view_audit_log"],
}


@query("SELECT 'definition ' || o_orderkey AS name, o_orderkey % 5 = 0 AS is_preset, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created FROM orders UNION ALL SELECT p_name, false, '1998-06-01' FROM part")
def rs_15_created(s, d):
    """Saved definitions with new ones, named by the parts, that ask to be presets; presets first, newest first."""
    held = E.table(s, d, "orders").select(F.concat(F.lit("definition "), "o_orderkey").alias("name"), (F.col("o_orderkey") % 5 == 0).alias("is_preset"), F.col("o_orderdate").cast("date").cast("string").alias("created"))
    asked = E.table(s, d, "part").select(F.col("p_name").alias("name"), F.lit(True).alias("is_preset"), E.now().cast("date").cast("string").alias("created"))
    return M.create_definitions(held, asked).orderBy(F.col("is_preset").desc(), F.col("created").desc(), "name")


@query("""SELECT r.project_id, code, area_id, c_name AS owner, n AS task_count, late AS overdue_count, b AS blocked_count, c AS complete_count, pct AS percent_complete, r.status, health, line_no, part_id, t.assignee_id, t.status AS task_status, priority, CAST(due_date AS VARCHAR) AS due_date, percent_complete AS task_percent
  FROM rollup_ r LEFT JOIN customer ON c_custkey = owner_id LEFT JOIN tasks t ON t.project_id = r.project_id WHERE r.project_id = 7""")
def v_4_project_with_tasks(s, d):
    """V-4: project 7 with its rollup and owner on each row of its tasks, in order."""
    t = E.tasks(s, d).where("project_id = 7")
    r = A.project_rollup(E.projects_with_area(s, d).where("project_id = 7"), t, E.as_of())
    r = r.select("project_id", "code", "area_id", F.col("owner_name").alias("owner"), "task_count", "overdue_count", "blocked_count", "complete_count", "percent_complete", "status", "health")
    lines = t.select("project_id", "line_no", "part_id", "assignee_id", F.col("status").alias("task_status"), "priority", day("due_date"), F.col("percent_complete").alias("task_percent"))
    return r.join(lines, "project_id", "left").orderBy("line_no", "part_id")


# --- the board brief ------------------------------------------------------------------------


CARDS = ["Tactics", "Tasks", "Avg completion", "Overdue", "Blocked", "Complete"]


def cells(*values: str) -> str:
    return "'<tr><td>' || " + " || '</td><td>' || ".join(values) + " || '</td></tr>'"


BRIEF_TASK = cells("'line ' || line_no || ' of part ' || part_id", f"coalesce({SHOWN}, CAST(assignee_id AS VARCHAR))", "t.status", "percent_complete || '%'", f"CASE WHEN t.status <> 'Complete' AND due_date < {ASOF} THEN '<b>' || due_date || '</b>' ELSE CAST(due_date AS VARCHAR) END", "coalesce(CAST(CAST(completed_at AS DATE) AS VARCHAR), '—')")
SHOWN_BY_USER = SHOWN.replace("user_id", "u.user_id")
BRIEF_KPI = cells(f"coalesce({SHOWN_BY_USER}, CAST(c.user_id AS VARCHAR))", "c.count", "c.target", "CASE WHEN c.count >= c.target THEN '✓ On target' ELSE 'Behind' END", "coalesce(e.source, '—')")
BRIEF_KEY = "'P' || lpad(CAST(project_id % 7 + 1 AS VARCHAR), 20, '0') || '-' || lpad(CAST(project_id AS VARCHAR), 20, '0')"


@query(f""", g AS (SELECT (SELECT count(*) FROM projects) AS p, count(*) AS n, coalesce(CAST(floor(avg(percent_complete) + 0.5) AS BIGINT), 0) AS pct, count(*) FILTER (status <> 'Complete' AND due_date < {ASOF}) AS late, count(*) FILTER (status = 'Blocked') AS b, count(*) FILTER (status = 'Complete') AS c FROM tasks),
  k AS (SELECT unnest(range(6)) AS i, unnest({CARDS}) AS label, unnest([CAST(p AS VARCHAR), CAST(n AS VARCHAR), pct || '%', CAST(late AS VARCHAR), CAST(b AS VARCHAR), CAST(c AS VARCHAR)]) AS value FROM g),
  s AS (SELECT event_type AS metric, user_id, CAST(date_trunc('week', ts) AS DATE) AS period_start, (['manual', 'salesforce'])[max(event_id) % 2 + 1] AS source FROM events GROUP BY 1, 2, 3)
  SELECT 0 AS part, CAST(i AS VARCHAR) AS key, '' AS project_key, '' AS line, '<div>' || CASE WHEN i IN (3, 4) AND value <> '0' THEN '<b>' || value || '</b>' ELSE value END || ' ' || label || '</div>' AS html FROM k
  UNION ALL SELECT 1, CAST(a.area_id AS VARCHAR), '', '', '<h2>' || any_value(area_name) || '</h2>' || coalesce('<p>Progress: ' || any_value(current_numeric) || CASE WHEN any_value(target_numeric) <> 0 THEN ' / ' || any_value(target_numeric) || ' (' || any_value({share("current_numeric", "target_numeric")}) || '%)' ELSE '' END || '</p>', '')
    || '<p>' || count(r.project_id) || ' tactics · ' || coalesce(sum(n), 0) || ' tasks · ' || CASE WHEN coalesce(sum(n), 0) = 0 THEN 0 ELSE CAST(floor(sum(r.s) / sum(n) + 0.5) AS BIGINT) END || '% complete</p>'
    FROM areas a LEFT JOIN targets t ON t.area_id = a.area_id LEFT JOIN rollup_ r ON r.area_id = a.area_id GROUP BY a.area_id
  UNION ALL SELECT 1, CAST(area_id AS VARCHAR), {BRIEF_KEY}, '', '<h3>' || code || ' — ' || coalesce(c_name, '') || ' · ' || status || ' · ' || pct || '% · ' || n || ' tasks' || CASE WHEN late > 0 THEN ' · <b>' || late || ' overdue</b>' ELSE '' END || '</h3>'
    FROM rollup_ JOIN areas USING (area_id) LEFT JOIN customer ON c_custkey = owner_id
  UNION ALL SELECT 1, CAST(area_id AS VARCHAR), {BRIEF_KEY}, coalesce(CAST(due_date AS VARCHAR), '9999') || ' ' || line_no || ' ' || part_id, {BRIEF_TASK} FROM tasks t JOIN projects USING (project_id) JOIN areas USING (area_id) LEFT JOIN users ON user_id = assignee_id
  UNION ALL SELECT 2, metric, '', '', '<h3>' || metric || ' (target ' || any_value(target) || '/wk)</h3>' FROM current GROUP BY metric
  UNION ALL SELECT 2, c.metric, '', coalesce({SHOWN_BY_USER}, CAST(c.user_id AS VARCHAR)) || ' ' || c.user_id, {BRIEF_KPI} FROM current c LEFT JOIN users u ON u.user_id = c.user_id LEFT JOIN s e ON e.metric = c.metric AND e.user_id = c.user_id AND e.period_start = c.period_start""")
def v_19_brief(s, d):
    """V-19, K-5: the board brief as lines of HTML in order: totals, areas with their tactics and tasks, the week's scorecard.

    A line is a row, so that a brief of any size is written by the executors; `part`, `key`, `project_key` and `line` are its place.
    The tables have no goals, units, descriptions or block notes.
    """
    text, num = F.lit, lambda c: F.col(c).cast("string")
    row = lambda *cs: F.concat(text("<tr><td>"), F.concat_ws("</td><td>", *cs), text("</td></tr>"))
    bold = lambda c, cond: F.when(cond, F.concat(text("<b>"), c, text("</b>"))).otherwise(c)
    at = lambda part, key, project, line, html: (text(part).alias("part"), key.cast("string").alias("key"), project.alias("project_key"), line.alias("line"), html.alias("html"))
    none, tasks = text(""), E.tasks(s, d)
    late = X.overdue(F.col("status"), F.col("due_date"), E.as_of())
    n = F.count(F.lit(1))
    one = tasks.agg(n.alias("v1"), F.coalesce(X.round_half_up(F.avg("percent_complete")), F.lit(0)).alias("v2"), F.count_if(late).alias("v3"), F.count_if(F.col("status") == "Blocked").alias("v4"), F.count_if(F.col("status") == "Complete").alias("v5"))
    one = one.crossJoin(E.projects(s, d).agg(n.alias("v0")))  # one row each
    card = lambda k: F.concat(text("<div>"), bold(F.concat(num(f"v{k}"), text("%" if k == 2 else "")), F.lit(k in (3, 4)) & (F.col(f"v{k}") != 0)), text(f" {CARDS[k]}</div>"))
    cards = one.select(F.posexplode(F.array(*(card(k) for k in range(6)))).alias("k", "html"))
    r = rollup_with_area(s, d)
    areas = A.area_rollup(E.focus_areas(s, d), r).join(E.targets(s, d).select("area_id", "current_numeric", "target_numeric"), "area_id", "left")
    goal = F.when(F.col("target_numeric") != 0, F.concat(text(" / "), num("target_numeric"), text(" ("), X.percent(F.col("current_numeric"), F.col("target_numeric")).cast("string"), text("%)"))).otherwise("")
    goal = F.when(F.col("current_numeric").isNotNull(), F.concat(text("<p>Progress: "), num("current_numeric"), goal, text("</p>"))).otherwise("")
    area = F.concat(text("<h2>"), X.html_text(F.col("area_name")), text("</h2>"), goal, text("<p>"), num("project_count"), text(" tactics · "), num("task_count"), text(" tasks · "), num("percent_complete"), text("% complete</p>"))
    known = E.focus_areas(s, d).select("area_id")
    more = F.when(F.col("overdue_count") > 0, F.concat(text(" · <b>"), num("overdue_count"), text(" overdue</b>"))).otherwise("")
    head = F.concat(text("<h3>"), X.html_text(F.col("code")), text(" — "), X.html_text(F.col("owner_name")), text(" · "), F.col("status"), text(" · "), num("percent_complete"), text("% · "), num("task_count"), text(" tasks"), more, text("</h3>"))
    of = E.projects_with_area(s, d).join(known, "area_id").select("project_id", "area_id", X.natural_key(F.col("code")).alias("project_key"))
    shown = shown_users(s, d).select("user_id", "shown")
    lines = tasks.join(of, "project_id").join(shown.withColumnRenamed("user_id", "assignee_id"), "assignee_id", "left")
    due = F.coalesce(num("due_date"), text("—"))
    task = row(F.concat(text("line "), num("line_no"), text(" of part "), num("part_id")), X.html_text(F.coalesce("shown", num("assignee_id"))), F.col("status"), F.concat(num("percent_complete"), text("%")), bold(due, late), F.coalesce(F.to_date("completed_at").cast("string"), text("—")))
    week = filled(s, d).where(F.col("period_start") == X.monday(E.kpi_now()))
    kpi = week.join(shown, "user_id", "left").withColumn("shown", F.coalesce("shown", num("user_id")))
    title = F.concat(text("<h3>"), X.html_text(F.col("metric")), text(" (target "), num("target"), text("/wk)</h3>"))
    score = row(X.html_text(F.col("shown")), num("count"), num("target"), F.when(F.col("count") >= F.col("target"), "✓ On target").otherwise("Behind"), X.html_text(F.coalesce("source", text("—"))))
    parts = [
        cards.select(*at(0, F.col("k"), none, none, F.col("html"))),
        areas.select(*at(1, F.col("area_id"), none, none, area)),
        r.join(known, "area_id").select(*at(1, F.col("area_id"), X.natural_key(F.col("code")), none, head)),
        lines.select(*at(1, F.col("area_id"), F.col("project_key"), F.concat_ws(" ", F.coalesce(num("due_date"), text("9999")), num("line_no"), num("part_id")), task)),
        week.groupBy("metric").agg(F.any_value("target").alias("target")).select(*at(2, F.col("metric"), none, none, title)),
        kpi.select(*at(2, F.col("metric"), none, F.concat_ws(" ", "shown", num("user_id")), score)),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("part", "key", "project_key", "line")
