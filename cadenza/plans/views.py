"""More queries by inventory id, each beside its DuckDB SQL.

They add to the catalog: plain scans and predicates, projections, composite views,
state changes and policies. Each takes (spark, sf_dir) and reads whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import maintain as M
from ..operators import report as R
from ..operators import rollups as A
from ..sources import entities as E
from ..sources import sinks as K
from .catalog import current, day, filled, one_line, rollup, rollup_with_area, spine, tables
from .oracle import ASOF, BASE, KPI, LINE, NOW, SRC, share, usd

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {BASE} {sql}"
        return f

    return add


def rows():
    return F.count(F.lit(1)).alias("n")


# --- scans and sources -----------------------------------------------------------


@query("SELECT * FROM users")
def s_1_full_scan(s, d):
    return E.users(s, d)


@query("SELECT * FROM (SELECT c_custkey AS id, s AS source_system, c_name AS last_name, c_nationkey AS account_id FROM (SELECT *, " + SRC + "[c_custkey % 2 + 1] AS s FROM customer)) WHERE source_system = 'salesforce' AND account_id = 8")
def s_4_people(s, d):
    return E.read_filtered(E.people(s, d), source_system="salesforce", account_id=8)


@query(f"SELECT event_id AS id, {SRC}[event_id % 2 + 1] AS source_system, event_id % 200 AS campaign_id FROM events WHERE event_id % 200 = 7")
def s_7_email_activity(s, d):
    return E.read_filtered(E.email_activity(s, d), source_system=None, campaign_id=7).select("id", "source_system", "campaign_id")


@query("SELECT source_system, count(*) AS n, CAST(count(amount) AS BIGINT) AS with_amount FROM opps GROUP BY 1")
def s_11_adapters(s, d):
    """Every adapter's opportunities through the one reading function."""
    parts = [E.adapter(s, d, x)["opportunities"] for x in E.SOURCES]
    return parts[0].unionByName(parts[1]).groupBy("source_system").agg(rows(), F.count("amount").alias("with_amount"))


@query("SELECT 'definition ' || o_orderkey AS name, o_orderkey % 5 = 0 AS is_preset FROM orders")
def s_17_definitions(s, d):
    """Saved definitions, presets first, newest first."""
    o = E.table(s, d, "orders").select(F.concat(F.lit("definition "), "o_orderkey").alias("name"), (F.col("o_orderkey") % 5 == 0).alias("is_preset"), "o_orderdate", "o_orderkey")
    return o.orderBy(F.col("is_preset").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("name", "is_preset")


@query("SELECT 'definition ' || o_orderkey AS name, o_orderkey % 5 = 0 AS is_preset, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created, o_orderkey AS id FROM orders")
def s_17_definitions_all(s, d):
    """All saved definitions, presets first, newest first; s_17_definitions has the first fifty."""
    o = E.table(s, d, "orders").select(F.concat(F.lit("definition "), "o_orderkey").alias("name"), (F.col("o_orderkey") % 5 == 0).alias("is_preset"), "o_orderdate", F.col("o_orderkey").alias("id"))
    return o.orderBy(F.col("is_preset").desc(), F.col("o_orderdate").desc(), F.col("id").desc()).select("name", "is_preset", F.col("o_orderdate").cast("date").cast("string").alias("created"), "id")


# --- sinks --------------------------------------------------------------------------


@query("SELECT CAST(to_json({'area_id': area_id, 'area_name': area_name, 'target_numeric': target_numeric}) AS VARCHAR) AS value FROM areas LEFT JOIN targets USING (area_id)")
def k_1_json(s, d):
    return K.json_rows(E.focus_areas(s, d).join(E.targets(s, d), "area_id", "left").select("area_id", "area_name", "target_numeric"))


@query("SELECT 0 AS part, 'Id,\"Name, full\"' AS line UNION ALL SELECT 1, user_id || ',' || coalesce(display_name, '') FROM users")
def k_2_csv(s, d):
    return K.csv_lines(E.users(s, d), [("user_id", "Id"), ("display_name", "Name, full")])


@query(f"SELECT 'cover' AS sheet, 1 AS n UNION ALL SELECT 'initiatives', count(*) FROM areas UNION ALL SELECT 'completed', count(*) FROM tasks WHERE status = 'Complete' AND completed_at >= {NOW} - INTERVAL 30 DAY UNION ALL SELECT 'weekly', count(*) FROM (SELECT DISTINCT metric, user_id FROM filled)")
def k_3_sheets(s, d):
    """The rows of four sheets of the workbook; k_3_all_sheets has those of all five."""
    return sheet_rows({name: df for name, df in sheets(s, d).items() if name != "drill_down"})


def sheets(s, d) -> dict[str, DataFrame]:
    """The sheets of the workbook, as sinks.write_sheets takes them."""
    return {
        "cover": A.cover(rollup(s, d)), "initiatives": A.initiatives(E.focus_areas(s, d), rollup_with_area(s, d), E.targets(s, d)), "drill_down": v_15_drill_down_rows(s, d),
        "completed": completed(s, d), "weekly": filled(s, d).select("metric", "user_id").distinct(),
    }


def sheet_rows(sheets: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(rows()).select(F.lit(name).alias("sheet"), "n") for name, df in sheets.items()])


@query(f"SELECT 'cover' AS sheet, 1 AS n UNION ALL SELECT 'initiatives', count(*) FROM areas UNION ALL SELECT 'drill_down', (SELECT count(*) FROM areas) + (SELECT count(*) FROM projects JOIN areas USING (area_id)) + (SELECT count(*) FROM tasks JOIN projects USING (project_id) JOIN areas USING (area_id)) UNION ALL SELECT 'completed', count(*) FROM tasks WHERE status = 'Complete' AND completed_at >= {NOW} - INTERVAL 30 DAY UNION ALL SELECT 'weekly', count(*) FROM (SELECT DISTINCT metric, user_id FROM filled)")
def k_3_all_sheets(s, d):
    return sheet_rows(sheets(s, d))


NATURAL = "'P' || lpad(CAST(project_id % 7 + 1 AS VARCHAR), 20, '0') || '-' || lpad(CAST(project_id AS VARCHAR), 20, '0')"


@query(f"""SELECT 0 AS level, area_id, '' AS project_key, NULL AS line_no, NULL AS part_id, '▸ ' || area_name AS name, '' AS owner, count(r.project_id) || ' tactics' AS status, '' AS priority, '' AS due, '' AS completed,
    CASE WHEN coalesce(sum(r.n), 0) = 0 THEN 0 ELSE floor(sum(r.s) / sum(r.n) + 0.5) / 100 END AS percent, '' AS notes FROM areas LEFT JOIN rollup_ r USING (area_id) GROUP BY area_id, area_name
  UNION ALL SELECT 1, area_id, {NATURAL}, NULL, NULL, '    ' || code, coalesce(c_name, ''), status, '', '', '', pct / 100, '' FROM rollup_ JOIN areas USING (area_id) LEFT JOIN customer ON c_custkey = owner_id
  UNION ALL SELECT 2, area_id, {NATURAL}, line_no, part_id, '        ' || project_id || '/' || line_no, CASE WHEN user_id IS NULL THEN CAST(assignee_id AS VARCHAR) WHEN length(display_name) > 0 THEN display_name WHEN length(concat_ws(' ', nullif(first_name, ''), nullif(last_name, ''))) > 0 THEN concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')) WHEN length(email) > 0 THEN split_part(email, '@', 1) ELSE left(CAST(user_id AS VARCHAR), 8) END,
    status, priority, coalesce(CAST(due_date AS VARCHAR), ''), coalesce(CAST(CAST(completed_at AS DATE) AS VARCHAR), ''), percent_complete / 100, CASE WHEN blocked_by_id IS NULL THEN '' ELSE 'Blocker: ' || blocked_by_id END
    FROM tasks JOIN projects USING (project_id) JOIN areas USING (area_id) LEFT JOIN users ON user_id = assignee_id""")
def v_15_drill_down_rows(s, d):
    """The outline: each area (0), its projects (1) and their tasks (2), in the sheet's order; v_15_drill_down counts them.

    The tables have no goals, project names, descriptions or notes: a project is named by its
    code, a task by project and line, and its notes name who blocks it.
    """
    late = F.when(F.col("due") == "", "9999").otherwise(F.col("due"))
    columns = ["level", "area_id", "project_key", "line_no", "part_id", "name", "owner", "status", "priority", "due", "completed", "percent", "notes"]
    return drill_down_lines(s, d).orderBy("sort_order", "area_id", "project_key", "level", late, "line_no", "part_id").select(columns)


def drill_down_lines(s, d) -> DataFrame:
    """The outline's rows in no order."""
    text = lambda v="": F.lit(v)
    areas = E.focus_areas(s, d).select("area_id", "sort_order")
    keyed = rollup_with_area(s, d).join(areas, "area_id").withColumn("project_key", X.natural_key(F.col("code")))
    top = A.area_rollup(E.focus_areas(s, d), rollup_with_area(s, d)).select(
        F.lit(0).alias("level"), "sort_order", "area_id", text().alias("project_key"), F.concat(text("▸ "), "area_name").alias("name"), text().alias("owner"), F.concat(F.col("project_count"), text(" tactics")).alias("status"),
        text().alias("priority"), text().alias("due"), text().alias("completed"), (F.col("percent_complete") / 100).alias("percent"), text().alias("notes"),
    )
    tactics = keyed.select(
        F.lit(1).alias("level"), "sort_order", "area_id", "project_key", F.concat(text("    "), "code").alias("name"), F.coalesce("owner_name", text()).alias("owner"), "status",
        text().alias("priority"), text().alias("due"), text().alias("completed"), (F.col("percent_complete") / 100).alias("percent"), text().alias("notes"),
    )
    shown = X.display_name(F.col("display_name"), F.col("first_name"), F.col("last_name"), F.col("email"), F.col("user_id").cast("string"))
    owners = E.users(s, d).select(F.col("user_id").alias("assignee_id"), shown.alias("owner"))
    none = F.lit(None).cast("string")
    of = E.projects_with_area(s, d).join(areas, "area_id").select("project_id", "area_id", "sort_order", X.natural_key(F.col("code")).alias("project_key"))
    tasks = E.tasks(s, d).join(of, "project_id").join(owners, "assignee_id", "left").select(
        F.lit(2).alias("level"), "sort_order", "area_id", "project_key", "line_no", "part_id", F.concat(text("        "), F.col("project_id"), text("/"), F.col("line_no")).alias("name"),
        F.coalesce("owner", F.col("assignee_id").cast("string")).alias("owner"), "status", "priority", F.coalesce(F.col("due_date").cast("string"), text()).alias("due"),
        F.coalesce(F.col("completed_at").cast("date").cast("string"), text()).alias("completed"), (F.col("percent_complete") / 100).alias("percent"), X.notes(F.col("blocked_by_id").cast("string"), none, none).alias("notes"),
    )
    return top.unionByName(tactics).unionByName(tasks, allowMissingColumns=True)


@query("SELECT '<tr><td>' || area_id || '</td><td>' || area_name || '</td></tr>' AS row FROM areas")
def k_5_html_rows(s, d):
    cell = lambda c: F.concat(F.lit("<td>"), X.html_text(F.col(c)), F.lit("</td>"))
    return E.focus_areas(s, d).select(F.concat(F.lit("<tr>"), cell("area_id"), cell("area_name"), F.lit("</tr>")).alias("row"))


@query("SELECT area_id, area_name FROM areas UNION ALL SELECT 90, 'New' UNION ALL SELECT 91, NULL")
def k_6_insert(s, d):
    return E.focus_areas(s, d).select("area_id", "area_name").unionByName(s.createDataFrame([(90, "New"), (91, None)], "area_id int, area_name string"))


@query("SELECT status, count(*) AS n FROM tasks WHERE NOT coalesce(blocked_by_id = 4, false) GROUP BY 1")
def k_8_delete(s, d):
    return M.delete(E.tasks(s, d), F.col("blocked_by_id") == 4).groupBy("status").agg(rows())


@query("SELECT CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id END AS assignee_id, count(*) AS n FROM tasks LEFT JOIN users ON assignee_id = user_id GROUP BY 1")
def k_9_set_null(s, d):
    return M.set_null(E.tasks(s, d).withColumnRenamed("assignee_id", "user_id"), E.users(s, d).where("NOT is_active"), "user_id").groupBy(F.col("user_id").alias("assignee_id")).agg(rows())


@query("""SELECT CAST(user_id AS VARCHAR) AS target_id, 'boss' AS actor_id, CAST(to_json({'role': role}) AS VARCHAR) AS before, CAST(to_json({'role': 'lead', 'actingAs': 'x'}) AS VARCHAR) AS after FROM users WHERE role = 'member'""")
def k_13_audit(s, d):
    u = E.users(s, d).select("user_id", "role")
    return M.audit_rows(u, M.update(u, F.col("role") == "member", role=F.lit("lead")), "user_id", "boss", "x")


# --- filters and projections ------------------------------------------------------------


@query(f"SELECT {LINE} FROM tasks WHERE status = 'Blocked'")
def f_1_equality(s, d):
    return one_line(E.tasks(s, d).where(F.col("status") == "Blocked"))


@query("SELECT id, channel FROM camps WHERE source_system = 'hubspot'")
def f_2_optional_terms(s, d):
    return E.campaigns(s, d).where(X.where_all(None, F.col("source_system") == "hubspot", None)).select("id", "channel")


@query("SELECT blocked_by_id IS NULL AS free, count(*) AS n FROM tasks WHERE escalated_at IS NULL OR escalation_resolved_at IS NOT NULL GROUP BY 1")
def f_4_null_terms(s, d):
    t = E.tasks(s, d).where(F.col("escalated_at").isNull() | F.col("escalation_resolved_at").isNotNull())
    return t.groupBy(F.col("blocked_by_id").isNull().alias("free")).agg(rows())


@query("SELECT metric, user_id, CAST(period_start AS VARCHAR) AS period_start, count FROM entries WHERE period_start >= DATE '2024-01-15'")
def f_5_since(s, d):
    return E.metric_entries(s, d).where(F.col("period_start") >= F.to_date(F.lit("2024-01-15"))).select("metric", "user_id", day("period_start"), "count")


@query("SELECT CAST(count(*) AS DOUBLE) AS n, channel FROM camps WHERE channel IN ('Email', 'Referral') AND sends > 30 AND clicks <= 20 AND source_system <> 'hubspot' AND opens >= 4 AND opens < 190 GROUP BY 2")
def f_8_report_operators(s, d):
    fs = [R.Filter("channel", "in", ["Email", "Referral"]), R.Filter("sends", "gt", "30"), R.Filter("clicks", "lte", 20), R.Filter("source_system", "neq", "hubspot"), R.Filter("opens", "gte", 4), R.Filter("opens", "lt", 190)]
    return R.run_report(tables(s, d), R.Spec(["campaigns"], [R.Metric("count", label="n")], ["channel"], fs))


@query("SELECT coalesce(blocked_by_id = 5 AND status = 'Blocked', false) AS blocking, count(*) AS n FROM tasks GROUP BY 1")
def f_15_blocking_viewer(s, d):
    return E.tasks(s, d).groupBy(F.coalesce((F.col("blocked_by_id") == 5) & (F.col("status") == "Blocked"), F.lit(False)).alias("blocking")).agg(rows())


REQUESTS = "(SELECT event_id AS id, (['pending', 'approved', 'denied'])[event_id % 3 + 1] AS status, CASE WHEN event_id % 3 <> 0 THEN user_id END AS decided_by_id, (['account', 'access'])[event_id % 2 + 1] AS kind, user_id AS requester_user_id FROM events)"


@query(f"SELECT id, kind FROM {REQUESTS} WHERE status = 'denied'")
def f_21_requests_by_status(s, d):
    return E.read_filtered(E.access_requests(s, d), status="denied").select("id", "kind")


@query("SELECT status, priority, count(*) AS n FROM tasks WHERE status = 'Blocked' GROUP BY 1, 2")
def f_22_known_values(s, d):
    """A status of the vocabulary filters; a priority outside it is ignored."""
    ask = lambda c, v, known: F.col(c) == v if v in known else None
    t = E.tasks(s, d).where(X.where_all(ask("status", "Blocked", X.TASK_STATUS), ask("priority", "Someday", X.TASK_PRIORITY)))
    return t.groupBy("status", "priority").agg(rows())


@query("SELECT f AS filter, count(*) AS n FROM rollup_ JOIN (VALUES ('onTrack', 'In Progress'), ('atRisk', 'At Risk'), ('blocked', 'Blocked'), ('complete', 'Complete'), ('notStarted', 'Not Started')) v(f, x) ON x = status GROUP BY 1")
def f_23_project_filters(s, d):
    names = {"In Progress": "onTrack", "At Risk": "atRisk", "Blocked": "blocked", "Complete": "complete", "Not Started": "notStarted"}
    name = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("status"))
    return rollup(s, d).where(F.col("status").isin(list(names))).groupBy(name.alias("filter")).agg(rows())


@query("SELECT 'open' AS mode, user_id FROM work WHERE open > 0 UNION ALL SELECT 'overdue', user_id FROM work WHERE overdue > 0 UNION ALL SELECT 'all', user_id FROM work")
def f_25_people_modes(s, d):
    w = A.workload(E.users(s, d), E.tasks(s, d), E.as_of())
    mode = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("open") > 0, "open"), F.when(F.col("overdue") > 0, "overdue"))))
    return w.select(mode.alias("mode"), "user_id")


@query("SELECT position, value FROM (SELECT position, " + usd("amount") + " AS value FROM stage LEFT JOIN opps ON stage = stage_canonical GROUP BY 1) WHERE value > 0")
def f_26_nonzero_slices(s, d):
    return A.pipeline_by_stage(E.opportunities(s, d)).where("value > 0").select("position", "value")


@query(f"SELECT status = 'pending' AS pending, count(*) AS n FROM {REQUESTS} GROUP BY 1")
def f_28_pending_or_decided(s, d):
    return E.access_requests(s, d).groupBy((F.col("status") == "pending").alias("pending")).agg(rows())


@query("SELECT p.project_id, code, owner_id, c_name AS owner_name, p.area_id, area_name FROM projects p LEFT JOIN customer ON owner_id = c_custkey LEFT JOIN areas a ON p.area_id = a.area_id")
def p_2_project(s, d):
    """J-1, J-7: a project with its owner's and its area's name."""
    return E.projects_with_area(s, d).join(F.broadcast(E.focus_areas(s, d)), "area_id", "left").select("project_id", "code", "owner_id", "owner_name", "area_id", "area_name")


@query("SELECT event_id, 'https://x/' || event_id AS url, user_name AS added_by FROM events LEFT JOIN users USING (user_id)")
def p_3_attachment(s, d):
    a = E.events(s, d).select(F.struct(F.col("event_id"), F.concat(F.lit("https://x/"), "event_id").alias("url")).alias("a"), "user_id")
    return a.join(E.users(s, d).select("user_id", "user_name"), "user_id", "left").select("a.event_id", "a.url", F.col("user_name").alias("added_by"))


@query("SELECT source, count(*) AS n FROM (SELECT 'accounts' AS source FROM accounts UNION ALL SELECT 'campaigns' FROM camps) GROUP BY 1")
def p_4_source_tag(s, d):
    t = tables(s, d)
    t["accounts"] = t["accounts"].withColumn("source", F.lit("its own"))  # the tag replaces it
    return R.union_sources(t, ["accounts", "campaigns"]).groupBy("source").agg(rows())


@query("SELECT status, priority, count(*) AS n FROM (SELECT CASE WHEN project_id = 7 THEN 'Complete' ELSE status END AS status, priority FROM tasks) GROUP BY 1, 2")
def p_5_partial_update(s, d):
    """Only the supplied fields change."""
    given = {"status": "Complete", "priority": None}
    return M.update(E.tasks(s, d), F.col("project_id") == 7, **{c: F.lit(v) for c, v in given.items() if v is not None}).groupBy("status", "priority").agg(rows())


@query("SELECT user_id, role, email IS NOT NULL AS has_login FROM users")
def p_6_user(s, d):
    return E.users(s, d).select("user_id", "role", F.col("email").isNotNull().alias("has_login"))  # a login needs an address here


# --- joins --------------------------------------------------------------------------------


@query("SELECT user_id % 5 AS group_id, user_id, user_name FROM users WHERE user_id % 5 = 2")
def j_2_members(s, d):
    g = E.group_members(s, d).where("group_id = 2")
    return g.join(E.users(s, d).select("user_id", "user_name"), "user_id").select("group_id", "user_id", "user_name")


@query("SELECT user_name AS assignee, e.user_name AS escalated_to, count(*) AS n FROM tasks LEFT JOIN users u ON assignee_id = u.user_id LEFT JOIN (SELECT user_id AS k, user_name FROM users) e ON escalated_to_id = k GROUP BY 1, 2".replace("SELECT user_name AS", "SELECT u.user_name AS", 1))
def j_5_user_roles(s, d):
    t = E.tasks(s, d).groupBy("assignee_id", "escalated_to_id").agg(rows())  # names join to counts, not to tasks
    for role in ("assignee", "escalated_to"):
        t = t.join(E.users(s, d).select(F.col("user_id").alias(f"{role}_id"), F.col("user_name").alias(role)), f"{role}_id", "left")
    return t.groupBy("assignee", "escalated_to").agg(F.sum("n").alias("n"))


@query("SELECT area_id, count(*) AS n FROM tasks LEFT JOIN projects USING (project_id) GROUP BY 1")
def j_6_task_project(s, d):
    by = E.tasks(s, d).groupBy("project_id").agg(rows())
    return by.join(E.projects_with_area(s, d).select("project_id", "area_id"), "project_id", "left").groupBy("area_id").agg(F.sum("n").alias("n"))


@query("SELECT area_id, p AS projects, t AS tasks FROM areas LEFT JOIN (SELECT area_id, count(*) AS p, CAST(sum(n) AS BIGINT) AS t FROM r1 GROUP BY 1) USING (area_id)")
def j_9_two_level_nest(s, d):
    """Areas with nested projects with nested task counts, shown by their sizes (a hot area's tasks are never one array)."""
    by = E.projects_with_area(s, d).select("project_id", "area_id").join(E.tasks(s, d).groupBy("project_id").agg(rows()), "project_id", "left")
    nested = by.groupBy("area_id").agg(F.count(F.lit(1)).alias("projects"), F.coalesce(F.sum("n"), F.lit(0)).alias("tasks"))
    return E.focus_areas(s, d).select("area_id").join(nested, "area_id", "left")


@query("SELECT project_id, n FROM r1")
def j_10_multimap(s, d):
    return E.projects(s, d).select("project_id").join(E.tasks(s, d).groupBy("project_id").agg(rows()), "project_id", "left").fillna(0, ["n"])


@query("SELECT area_id, area_name, target_numeric FROM areas LEFT JOIN targets USING (area_id)")
def j_11_area_target(s, d):
    return E.focus_areas(s, d).join(E.targets(s, d).select("area_id", "target_numeric"), "area_id", "left").select("area_id", "area_name", "target_numeric")


@query("SELECT metric, count(DISTINCT user_id) AS users, count(*) AS cells FROM filled GROUP BY 1")
def j_12_j_13_spine(s, d):
    """Metrics by users they apply to, by six weeks."""
    return spine(s, d).groupBy("metric", "user_id").agg(rows()).groupBy("metric").agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("cells"))


@query("SELECT metric, count(*) FILTER (has) AS reported, count(*) AS n FROM (SELECT c.metric, e.user_id IS NOT NULL AS has FROM current c LEFT JOIN entries e ON c.metric = e.metric AND c.user_id = e.user_id AND c.period_start = e.period_start) GROUP BY 1")
def j_15_current_entries(s, d):
    return current(s, d).groupBy("metric").agg(F.count("id").alias("reported"), rows())


@query(f"SELECT id, status, user_name AS decided_by FROM {REQUESTS} LEFT JOIN users ON user_id = decided_by_id")
def j_20_deciders(s, d):
    u = E.users(s, d).select(F.col("user_id").alias("decided_by_id"), F.col("user_name").alias("decided_by"))
    return E.access_requests(s, d).join(u, "decided_by_id", "left").select("id", "status", "decided_by")


INVITATIONS = "(SELECT event_id AS id, user_id AS target_user_id, (['pending', 'accepted', 'revoked'])[event_id % 3 + 1] AS status, ts + INTERVAL 7 DAY AS expires_at, CASE WHEN event_id % 4 <> 0 THEN 'USER' || (event_id % 40) || '@example.com' END AS email FROM events)"


@query(f"SELECT id, status, user_name AS target FROM {INVITATIONS} LEFT JOIN users ON user_id = target_user_id")
def j_21_invitation_targets(s, d):
    u = E.users(s, d).select(F.col("user_id").alias("target_user_id"), F.col("user_name").alias("target"))
    return E.invitations(s, d).join(u, "target_user_id", "left").select("id", "status", "target")


@query("SELECT user_id, open, overdue FROM work")
def j_22_user_workload(s, d):
    return A.workload(E.users(s, d), E.tasks(s, d), E.as_of()).select("user_id", "open", "overdue")


# --- aggregates -----------------------------------------------------------------------------


@query("SELECT status, health, count(*) AS n FROM rollup_ GROUP BY 1, 2")
def a_5_a_6_ladders(s, d):
    return rollup(s, d).groupBy("status", "health").agg(rows())


def initiatives(s, d) -> DataFrame:
    return A.initiatives(E.focus_areas(s, d), rollup_with_area(s, d), E.targets(s, d))


@query(f"""SELECT area_id, CASE WHEN count(project_id) = 0 THEN 'No Tasks' WHEN count(*) FILTER (status = 'Complete') = count(project_id) THEN 'Complete' WHEN count(*) FILTER (health = 'red') > 0 THEN 'Blocked'
  WHEN count(*) FILTER (health = 'amber') > 0 THEN 'At Risk' ELSE 'On Track' END AS status, any_value(CASE WHEN target_numeric > 0 THEN {share("current_numeric", "target_numeric")} END) AS attainment
  FROM areas LEFT JOIN rollup_ USING (area_id) LEFT JOIN targets USING (area_id) GROUP BY 1""")
def a_13_a_14_initiative_status(s, d):
    return initiatives(s, d).select("area_id", "status", "attainment")


@query("SELECT area_id, CAST(sum(n) AS BIGINT) AS tasks, CASE WHEN sum(n) = 0 THEN 0 ELSE CAST(floor(sum(s) / sum(n) + 0.5) AS BIGINT) END AS percent_complete FROM r1 WHERE area_id IS NOT NULL GROUP BY ROLLUP (area_id)")
def a_16_tree_totals(s, d):
    """Task-weighted totals by area and over all (area_id null)."""
    by = rollup_with_area(s, d).where("area_id IS NOT NULL").rollup("area_id").agg(F.sum("task_count").alias("tasks"), F.sum("percent_sum").alias("p"))
    return by.select("area_id", "tasks", F.when(F.col("tasks") == 0, F.lit(0).cast("bigint")).otherwise(X.round_half_up(F.col("p") / F.col("tasks"))).alias("percent_complete"))


@query("SELECT metric, CAST(sum(count) AS BIGINT) AS total, CAST(any_value(target) * count(*) AS BIGINT) AS target, count(*) FILTER (count >= target) AS on_target FROM current GROUP BY 1")
def a_25_week_panel(s, d):
    on = F.count_if(F.col("count") >= F.col("target")).alias("on_target")
    return current(s, d).groupBy("metric").agg(F.sum("count").alias("total"), F.sum("target").alias("target"), on)


@query("SELECT area_id, count(*) FILTER (n > 0) AS active, CAST(sum(late) AS BIGINT) AS overdue, CAST(sum(b) AS BIGINT) AS blocked, CAST(sum(n) AS BIGINT) AS tasks, CAST(floor(avg(pct) + 0.5) AS BIGINT) AS percent_complete FROM rollup_ GROUP BY 1")
def a_27_pillars(s, d):
    total = [F.sum(f"{c}_count").alias(a) for c, a in (("overdue", "overdue"), ("blocked", "blocked"), ("task", "tasks"))]
    return rollup_with_area(s, d).groupBy("area_id").agg(F.count_if(F.col("task_count") > 0).alias("active"), *total, X.round_half_up(F.avg("percent_complete")).alias("percent_complete"))


@query(f"SELECT count(*) FILTER (status <> 'Complete') AS open, count(*) FILTER (status <> 'Complete' AND due_date < {ASOF}) AS overdue, count(*) FILTER (status = 'Blocked') AS blocked FROM tasks WHERE assignee_id = 4")
def a_28_person(s, d):
    st = F.col("status")
    return E.tasks(s, d).where("assignee_id = 4").agg(F.count_if(st != "Complete").alias("open"), F.count_if(X.overdue(st, F.col("due_date"), E.as_of())).alias("overdue"), F.count_if(st == "Blocked").alias("blocked"))


# --- report language --------------------------------------------------------------------------


def report(s, d, *args) -> DataFrame:
    return R.run_report(tables(s, d), R.Spec(*args))


@query("SELECT CAST(close_date AS VARCHAR) AS close_date, CAST(count(*) AS DOUBLE) AS n FROM opps GROUP BY 1")
def rs_5_date_dimension(s, d):
    return report(s, d, ["opportunities"], [R.Metric("count", label="n")], ["close_date"])


@query(f"SELECT channel, CAST(count(*) AS DOUBLE) AS count, {usd('influenced_pipeline')} AS sum_influenced_pipeline_1, {usd('influenced_pipeline')} / count(*) AS avg_influenced_pipeline_2, CAST(0 AS DOUBLE) AS sum_value_3 FROM camps GROUP BY 1")
def rs_7_to_rs_10_metrics(s, d):
    """Unnamed metrics: count, sum, an average over all rows, and a sum of no field."""
    return report(s, d, ["campaigns"], [R.Metric("count"), R.Metric("sum", "influenced_pipeline"), R.Metric("avg", "influenced_pipeline"), R.Metric("sum")], ["channel"])


@query("SELECT CAST(sum(clicks) AS DOUBLE) AS channel FROM camps GROUP BY camps.channel")
def rs_11_collision(s, d):
    """A label that is a dimension's name: the metric, written later, wins."""
    return report(s, d, ["campaigns"], [R.Metric("sum", "clicks", "channel")], ["channel"])


@query("SELECT stage_canonical, CAST(count(*) AS DOUBLE) AS n, row_number() OVER (ORDER BY count(*) DESC, stage_canonical) AS place FROM opps GROUP BY 1")
def rs_12_order(s, d):
    out = report(s, d, ["opportunities"], [R.Metric("count", label="n")], ["stage_canonical"])
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "stage_canonical")))  # a row per stage


@query("SELECT 'Email' AS channel, 'bar' AS chart, count(*) AS n FROM camps WHERE channel = 'Email'")
def rs_13_carried_through(s, d):
    spec = R.Spec(["campaigns"], [R.Metric("count", label="n")], ["channel"], [R.Filter("channel", "eq", "Email")], "channel", "bar")
    return R.run_report(tables(s, d), spec).select("channel", F.lit(spec.chart_type).alias("chart"), F.col("n").cast("bigint").alias("n"))


# --- windows, order and sets ---------------------------------------------------------------------


@query("SELECT metric, user_id, CAST(period_start AS VARCHAR) AS period_start, id FROM (SELECT event_type AS metric, user_id, CAST(date_trunc('week', ts) AS DATE) AS period_start, max(event_id) AS id FROM events GROUP BY 1, 2, 3)")
def w_4_last_wins(s, d):
    e = E.events(s, d).select(F.col("event_type").alias("metric"), "user_id", X.monday("ts").alias("period_start"), F.col("event_id").alias("id"), F.col("event_id").alias("kept"))
    return M.latest(e, ["metric", "user_id", "period_start"]).select("metric", "user_id", day("period_start"), F.col("kept").alias("id"))


@query("SELECT metric, user_id, CAST(period_start AS VARCHAR) AS period_start, CAST(sum(count) OVER (PARTITION BY metric, user_id ORDER BY period_start ROWS 5 PRECEDING) AS BIGINT) AS trailing FROM filled")
def w_5_trailing_weeks(s, d):
    w = Window.partitionBy("metric", "user_id").orderBy("period_start").rowsBetween(-5, 0)
    return filled(s, d).withColumn("trailing", F.sum("count").over(w)).select("metric", "user_id", day("period_start"), "trailing")


@query("SELECT metric, user_id, CAST(period_start AS VARCHAR) AS period_start, new_count - old_count AS delta FROM audit WHERE old_count IS NOT NULL AND old_count <> new_count")
def w_6_deltas(s, d):
    return M.kpi_audit(E.metric_entries(s, d)).where("old_count IS NOT NULL").select("metric", "user_id", day("period_start"), (F.col("new_count") - F.col("old_count")).alias("delta"))


@query("SELECT count(*) = 0 AS is_first, coalesce(bool_or(role = 'admin'), false) AS has_admin FROM users")
def w_7_first_user(s, d):
    return E.users(s, d).agg((F.count(F.lit(1)) == 0).alias("is_first"), F.coalesce(F.bool_or(F.col("role") == "admin"), F.lit(False)).alias("has_admin"))


def placed(df: DataFrame, *order) -> DataFrame:
    """The rows' place in an order, of a table that is small or cut to a page."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("SELECT area_id, row_number() OVER (ORDER BY sort_order DESC) AS place FROM areas")
def o_1_o_2_keys(s, d):
    return placed(E.focus_areas(s, d).select("area_id", "sort_order"), F.col("sort_order").desc(), "area_id").drop("sort_order")


@query("SELECT area_id, row_number() OVER (ORDER BY target_numeric ASC NULLS LAST, area_id) AS place FROM areas LEFT JOIN targets USING (area_id)")
def o_3_nulls_last(s, d):
    return placed(E.focus_areas(s, d).join(E.targets(s, d), "area_id", "left").select("area_id", "target_numeric"), F.col("target_numeric").asc_nulls_last(), "area_id").drop("target_numeric")


@query("SELECT area_id, project_id, code, 'P' || lpad(CAST(project_id % 7 + 1 AS VARCHAR), 20, '0') || '-' || lpad(CAST(project_id AS VARCHAR), 20, '0') AS natural_key FROM projects")
def o_5_natural_order_all(s, d):
    """All projects by area and natural order of their codes, with the key."""
    p = E.projects_with_area(s, d).select("area_id", "project_id", "code", X.natural_key(F.col("code")).alias("natural_key"))
    return p.orderBy(F.col("area_id").asc_nulls_last(), "natural_key", "project_id")


@query("SELECT user_id, total AS n FROM work")
def o_6_by_total(s, d):
    """The busiest first."""
    return A.workload(E.users(s, d), E.tasks(s, d), E.as_of()).select("user_id", F.col("total").alias("n")).orderBy(F.col("n").desc(), "user_id")


@query("SELECT user_id, open AS n FROM work")
def o_8_open_then_name(s, d):
    out = A.workload(E.users(s, d), E.tasks(s, d), E.as_of()).select("user_id", "user_name", F.col("open").alias("n"))
    return out.orderBy(F.col("n").desc(), "user_name").select("user_id", "n")


@query("SELECT user_id, total FROM work")
def o_6_by_total_all(s, d):
    """The whole workload, busiest first."""
    return A.workload(E.users(s, d), E.tasks(s, d), E.as_of()).select("user_id", "total").orderBy(F.col("total").desc(), "user_id")


@query("SELECT user_id, open, user_name FROM work")
def o_8_open_then_name_all(s, d):
    """All users by open tasks, then name."""
    return A.workload(E.users(s, d), E.tasks(s, d), E.as_of()).select("user_id", "open", "user_name").orderBy(F.col("open").desc(), F.collate("user_name", "UNICODE"), "user_id")


@query("SELECT project_id, line_no, part_id FROM tasks WHERE escalated_at IS NOT NULL ORDER BY escalated_at DESC, project_id, line_no, part_id LIMIT 10")
def o_7_o_9_o_10_newest(s, d):
    """The ten newest escalations, by time."""
    return E.tasks(s, d).where("escalated_at IS NOT NULL").orderBy(F.col("escalated_at").desc(), "project_id", "line_no", "part_id").limit(10).select("project_id", "line_no", "part_id")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 4")
def o_13_latest_four(s, d):
    return E.events(s, d).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(4).select("event_id")


@query("SELECT count(*) > 0 AS found FROM users WHERE role = 'vp'")
def o_14_probe(s, d):
    return E.users(s, d).where("role = 'vp'").limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


@query("SELECT source_system, n FROM (SELECT source_system, count(*) AS n FROM (SELECT source_system FROM opps UNION ALL SELECT source_system FROM camps) GROUP BY 1)")
def so_1_so_2_unions(s, d):
    return E.opportunities(s, d).unionByName(E.campaigns(s, d), allowMissingColumns=True).groupBy("source_system").agg(rows())


@query("SELECT status, unnest(range(2)) AS part, count(*) AS n FROM tasks GROUP BY 1, 2")
def so_3_flatten(s, d):
    return E.tasks(s, d).groupBy("status").agg(rows()).select("status", F.explode(F.flatten(F.array(F.array(F.lit(0)), F.array(F.lit(1))))).alias("part"), "n")


@query("SELECT role, list_sort(list(user_id)) = list_sort(list(CASE WHEN user_id = 4 THEN 5 ELSE user_id END)) AS same FROM users GROUP BY 1")
def so_6_set_equality(s, d):
    """Whether each role's users stay the same set after a change."""
    changed = F.when(F.col("user_id") == 4, F.lit(5).cast("bigint")).otherwise(F.col("user_id"))
    before, after = E.users(s, d).select("role", "user_id"), E.users(s, d).select("role", changed.alias("user_id"))
    side = lambda df, k: df.distinct().withColumn("side", F.lit(k))
    both = side(before, 1).unionByName(side(after, 2)).groupBy("role", "user_id").agg(F.count(F.lit(1)).alias("sides"))
    return both.groupBy("role").agg((F.min("sides") == 2).alias("same"))


# --- scalars ------------------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def x_8_x_9_iso_day(s, d):
    return E.events(s, d).select("event_id", F.to_date(F.substring(F.col("ts").cast("string"), 1, 10)).cast("string").alias("day"))


@query("SELECT id, CAST(floor(x + 0.5) AS BIGINT) AS whole, floor(x * 100 + 0.5) / 100 AS cents, CASE WHEN y <> 0 THEN CAST(floor(x * 100 / y + 0.5) AS BIGINT) END AS percent FROM (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_custkey % 3 AS DOUBLE) AS y FROM customer)")
def x_11_to_x_13_rounding(s, d):
    c = E.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 3).cast("double").alias("y"))
    return c.select("id", X.round_half_up(F.col("x")).alias("whole"), X.round2(F.col("x")).alias("cents"), X.percent(F.col("x"), F.col("y")).alias("percent"))


@query("SELECT id, CASE WHEN name ILIKE '%widget%' THEN 'widgets' WHEN name ILIKE '%bolt%' OR name ILIKE '%rod%' THEN 'metal' ELSE 'other' END AS kind, split_part(name, ' ', 1) AS head FROM camps")
def x_23_x_24_classes(s, d):
    """The first pattern that matches decides; the text before the separator."""
    n = F.col("name")
    return E.campaigns(s, d).select("id", F.when(n.rlike("(?i)widget"), "widgets").when(n.rlike("(?i)bolt|rod"), "metal").otherwise("other").alias("kind"), F.split(n, " ")[0].alias("head"))


@query("SELECT area_id, CAST(to_json({'area_name': area_name, 'actingAs': 'x'}) AS VARCHAR) AS merged FROM areas")
def x_25_x_26_json(s, d):
    return E.focus_areas(s, d).select("area_id", F.to_json(F.struct("area_name", F.lit("x").alias("actingAs"))).alias("merged"))


# --- views ---------------------------------------------------------------------------------------


@query("""SELECT 'kpis' AS section, (SELECT count(*) FILTER (n > 0) FROM rollup_) AS n UNION ALL SELECT 'focusAreas', count(*) FROM areas UNION ALL SELECT 'workload', count(*) FROM work
  UNION ALL SELECT 'needsAttention', count(*) FROM tasks WHERE status = 'Blocked' OR (status <> 'Complete' AND due_date < DATE '1998-06-01')""")
def v_1_dashboard(s, d):
    """The dashboard's sections by their sizes; each is a query of its own."""
    r = rollup_with_area(s, d)
    late = X.overdue(F.col("status"), F.col("due_date"), E.as_of())
    parts = {
        "kpis": A.portfolio(r).select(F.col("active_projects").alias("n")), "focusAreas": A.area_rollup(E.focus_areas(s, d), r).agg(rows()), "workload": E.users(s, d).agg(rows()),
        "needsAttention": E.tasks(s, d).where(late | (F.col("status") == "Blocked")).agg(rows()),
    }
    a, b, c, e = (df.select(F.lit(k).alias("section"), "n") for k, df in parts.items())
    return a.unionByName(b).unionByName(c).unionByName(e)


@query("SELECT project_id, code, area_id, n AS task_count, pct AS percent_complete, status, health FROM rollup_")
def v_3_projects(s, d):
    return rollup_with_area(s, d).select("project_id", "code", "area_id", "task_count", "percent_complete", "status", "health")


@query(f"SELECT {LINE} FROM tasks WHERE project_id = 7")
def v_4_project_detail(s, d):
    return one_line(E.tasks(s, d).where("project_id = 7"))


@query(f"SELECT {LINE} FROM tasks WHERE assignee_id = 6 OR (blocked_by_id = 6 AND status = 'Blocked')")
def v_5_viewer_tasks(s, d):
    return one_line(E.tasks(s, d).where((F.col("assignee_id") == 6) | ((F.col("blocked_by_id") == 6) & (F.col("status") == "Blocked"))))


@query("SELECT 'inbox' AS list, count(*) AS n FROM tasks WHERE escalated_to_id = 3 AND escalation_resolved_at IS NULL UNION ALL SELECT 'blocked', count(*) FROM tasks WHERE status = 'Blocked' AND (escalated_at IS NULL OR escalation_resolved_at IS NOT NULL)")
def v_6_lists(s, d):
    inbox = F.expr("escalated_to_id = 3 AND escalation_resolved_at IS NULL")
    blocked = F.expr("status = 'Blocked' AND (escalated_at IS NULL OR escalation_resolved_at IS NOT NULL)")
    one = E.tasks(s, d).agg(F.count_if(inbox).alias("inbox"), F.count_if(blocked).alias("blocked"))  # one pass
    return one.select(F.expr("stack(2, 'inbox', inbox, 'blocked', blocked) AS (list, n)"))


@query("SELECT area_name, count(project_id) AS projects, CAST(coalesce(sum(n), 0) AS BIGINT) AS tasks, any_value(target_numeric) AS target FROM areas LEFT JOIN r1 USING (area_id) LEFT JOIN targets USING (area_id) GROUP BY 1")
def v_7_report_tree(s, d):
    t = E.targets(s, d).select("area_id", F.col("target_numeric").alias("target"))
    return A.area_rollup(E.focus_areas(s, d), rollup_with_area(s, d)).join(F.broadcast(t), "area_id", "left").select("area_name", F.col("project_count").alias("projects"), F.col("task_count").alias("tasks"), "target")


@query("""SELECT c.metric, c.user_id, c.count, coalesce(e.source, 'manual') AS source, coalesce(e.source = 'manual' AND c.user_id = 7, false) AS is_self_reported FROM current c LEFT JOIN
  (SELECT metric, user_id, period_start, (['manual', 'salesforce'])[max(event_id) % 2 + 1] AS source FROM (SELECT *, event_type AS metric, CAST(date_trunc('week', ts) AS DATE) AS period_start FROM events) GROUP BY 1, 2, 3) e
  ON e.metric = c.metric AND e.user_id = c.user_id AND e.period_start = c.period_start""")
def v_10_week_panel(s, d):
    mine = (F.col("source") == "manual") & (F.col("user_id") == 7)
    return current(s, d).select("metric", "user_id", "count", F.coalesce("source", F.lit("manual")).alias("source"), F.coalesce(mine, F.lit(False)).alias("is_self_reported"))


@query("SELECT user_id, CAST(period_start AS VARCHAR) AS period_start, metric, new_count FROM audit WHERE (old_count IS NULL OR old_count <> new_count) AND user_id = 7")
def v_12_r_5_own_history(s, d):
    """A member's view of the changes: own rows only."""
    return M.kpi_audit(E.metric_entries(s, d).where("user_id = 7")).select("user_id", day("period_start"), "metric", "new_count")


def completed(s, d) -> DataFrame:
    return E.tasks(s, d).where((F.col("status") == "Complete") & (F.col("completed_at") >= E.now() - F.expr("INTERVAL 30 DAYS")))


@query(f"""SELECT project_id, line_no, part_id, code, user_name AS assignee, CASE WHEN k <= 0 THEN CAST(-k AS VARCHAR) || ' early' ELSE CAST(k AS VARCHAR) || ' late' END AS vs_due
  FROM (SELECT *, CAST(floor((epoch_us(completed_at) - epoch_us(CAST(due_date AS TIMESTAMP))) / 86400e6 + 0.5) AS BIGINT) AS k FROM tasks WHERE status = 'Complete' AND completed_at >= {NOW} - INTERVAL 30 DAY)
  LEFT JOIN projects USING (project_id) LEFT JOIN users ON user_id = assignee_id""")
def v_16_completed_sheet(s, d):
    t = completed(s, d).join(E.projects(s, d).select("project_id", "code"), "project_id", "left")
    u = E.users(s, d).select(F.col("user_id").alias("assignee_id"), F.col("user_name").alias("assignee"))
    return t.join(u, "assignee_id", "left").select("project_id", "line_no", "part_id", "code", "assignee", X.days_vs_due(F.col("completed_at"), F.col("due_date")).alias("vs_due"))


@query("SELECT unnest(['projects', 'on_track', 'overdue_tasks']) AS label, unnest([count(*), count(*) FILTER (health = 'green'), CAST(sum(late) AS BIGINT)]) AS value FROM rollup_")
def v_18_cover_sheet(s, d):
    return A.cover(rollup(s, d)).select(F.expr("stack(3, 'projects', projects, 'on_track', on_track, 'overdue_tasks', overdue_tasks) AS (label, value)"))


@query("SELECT metric, CASE WHEN sum(count) >= sum(target) THEN 'On target' ELSE 'Behind' END AS verdict FROM current GROUP BY 1")
def v_19_scorecard(s, d):
    return current(s, d).groupBy("metric").agg(F.when(F.sum("count") >= F.sum("target"), "On target").otherwise("Behind").alias("verdict"))


@query("SELECT source_system, channel, count(*) AS n FROM camps GROUP BY 1, 2")
def v_22_campaigns(s, d):
    return E.campaigns(s, d).groupBy("source_system", "channel").agg(rows())


@query("SELECT source_system, count(*) AS events, max(event_id) AS latest FROM (SELECT *, " + SRC + "[event_id % 2 + 1] AS source_system FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 2 ORDER BY ts DESC, event_id DESC) <= 10) GROUP BY 1")
def v_23_status_cards(s, d):
    """Each connection with its ten latest events."""
    e = E.email_activity(s, d)
    w = Window.partitionBy("source_system").orderBy(F.col("sent_at").desc(), F.col("id").desc())
    top = e.withColumn("k", F.row_number().over(w)).where("k <= 10").groupBy("source_system").agg(F.count(F.lit(1)).alias("events"), F.max("id").alias("latest"))
    return E.connections(s).select("source_system").join(top, "source_system", "left")


@query("SELECT user_id % 5 AS group_id, count(*) AS members FROM users GROUP BY 1")
def v_24_groups(s, d):
    return E.group_members(s, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))


@query("SELECT area_id, current_numeric, user_name AS updated_by FROM targets LEFT JOIN users ON user_id = updated_by_id")
def v_25_targets(s, d):
    u = E.users(s, d).select(F.col("user_id").alias("updated_by_id"), F.col("user_name").alias("updated_by"))
    return E.targets(s, d).join(u, "updated_by_id", "left").select("area_id", "current_numeric", "updated_by")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 500")
def v_27_audit_log(s, d):
    n = X.clamped_limit(9999)
    return E.read_filtered(E.events(s, d), event_type="click").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n).select("event_id", "event_type")


@query(f"SELECT kind, status, count(*) AS n, count(decided_by_id) AS decided FROM {REQUESTS} GROUP BY 1, 2")
def v_28_requests(s, d):
    return E.access_requests(s, d).groupBy("kind", "status").agg(rows(), F.count("decided_by_id").alias("decided"))


# --- maintenance and policy -----------------------------------------------------------------------


@query("SELECT source_system, count(*) AS n, CAST(count(*) FILTER (source_system = 'hubspot') AS BIGINT) AS synced FROM (SELECT source_system FROM opps UNION ALL SELECT source_system FROM camps) GROUP BY 1")
def m_5_refresh(s, d):
    """Records of the refreshed source get the time of the refresh."""
    cols = ["source_system", F.lit(None).cast("timestamp").alias("synced_at")]
    both = E.opportunities(s, d).select(*cols).unionByName(E.campaigns(s, d).select(*cols))
    return M.update(both, F.col("source_system") == "hubspot", synced_at=E.now()).groupBy("source_system").agg(rows(), F.count("synced_at").alias("synced"))


@query("SELECT e.event_id AS task_id, 'opportunity' AS record_type, e.event_id * 3 AS record_id FROM events e JOIN opps ON id = e.event_id * 3")
def m_8_linked_tasks(s, d):
    """A task and its link only where the record exists."""
    asked = E.events(s, d).select(F.col("event_id").alias("task_id"), F.lit("opportunity").alias("record_type"), (F.col("event_id") * 3).alias("record_id"))
    return asked.join(E.opportunities(s, d).select(F.col("id").alias("record_id")), "record_id", "left_semi").select("task_id", "record_type", "record_id")


@query(f"""SELECT i.id, CASE WHEN u.user_id IS NULL THEN 'insert' WHEN is_active THEN 'reject' ELSE 'claim' END AS action, u.user_id FROM {INVITATIONS} i LEFT JOIN users u ON lower(u.email) = lower(i.email)""")
def m_9_claims(s, d):
    """A new user by address, in any case: reject a user who can log in, claim one who can't, insert the rest."""
    return M.claim_action(E.invitations(s, d).select("id", "email"), E.users(s, d).select("user_id", F.col("email").alias("known"), "is_active")).select("id", "action", "user_id")


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'pending' THEN CASE WHEN kind = 'access' THEN 'approved' ELSE 'denied' END ELSE status END AS status FROM {REQUESTS}) GROUP BY 1")
def m_10_decisions(s, d):
    """Only pending requests change state."""
    asked = F.when(F.col("kind") == "access", "approved").otherwise("denied")
    return M.update(E.access_requests(s, d), F.col("status") == "pending", status=asked).groupBy("status").agg(rows())


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'pending' AND expires_at > {KPI} THEN 'accepted' ELSE status END AS status FROM {INVITATIONS}) GROUP BY 1")
def m_12_acceptance(s, d):
    """Pending invitations that haven't expired are accepted."""
    return M.update(E.invitations(s, d), (F.col("status") == "pending") & (F.col("expires_at") > E.kpi_now()), status=F.lit("accepted")).groupBy("status").agg(rows())


@query("SELECT viewer, count(*) AS n FROM tasks JOIN (VALUES (3), (6)) v(viewer) ON assignee_id = viewer OR blocked_by_id = viewer WHERE project_id = 7 GROUP BY 1")
def r_3_single_task(s, d):
    """Tasks of one project that members may open, by member."""
    t = E.tasks(s, d).where("project_id = 7")
    seen = F.array_distinct(F.array_compact(F.array("assignee_id", "blocked_by_id")))
    return t.select(F.explode(seen).alias("viewer")).where("viewer IN (3, 6)").groupBy("viewer").agg(rows())


@query("SELECT CASE WHEN assignee_id = 6 OR blocked_by_id = 6 THEN 'seen' ELSE 'hidden' END AS attachments, count(*) AS n FROM tasks GROUP BY 1")
def r_4_attachments(s, d):
    return E.tasks(s, d).groupBy(F.when((F.col("assignee_id") == 6) | (F.col("blocked_by_id") == 6), "seen").otherwise("hidden").alias("attachments")).agg(rows())


@query("SELECT event_id FROM events WHERE CAST(date_trunc('week', ts) AS DATE) < DATE '2024-01-22' AND CAST(date_trunc('week', ts) AS DATE) <> DATE '2024-01-08'")
def st_2_late_edits(s, d):
    """Edits of locked weeks without an override."""
    over = s.createDataFrame([("2024-01-08",)], "p string").select(F.to_date("p").alias("period_start"))
    e = E.events(s, d).select("event_id", X.monday("ts").alias("period_start"))
    return e.where(X.week_locked(F.col("period_start"), E.kpi_now())).join(F.broadcast(over), "period_start", "left_anti").select("event_id")


@query(f"SELECT user_id, count(*) AS n FROM events WHERE ts + INTERVAL 7 DAY > {KPI} AND ts <= {KPI} GROUP BY 1")
def st_5_live_sessions(s, d):
    at = F.col("ts").cast("timestamp")
    return E.events(s, d).where((at + F.expr("INTERVAL 7 DAYS") > E.kpi_now()) & (at <= E.kpi_now())).groupBy("user_id").agg(rows())
