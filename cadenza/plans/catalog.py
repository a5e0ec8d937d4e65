"""Queries by inventory id. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import maintain as M
from ..operators import report as R
from ..operators import rollups as A
from ..sources import entities as E

QUERIES: dict[str, object] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rollup(s, d) -> DataFrame:
    return A.project_rollup(E.projects(s, d), E.tasks(s, d), E.as_of())


def rollup_with_area(s, d) -> DataFrame:
    return A.project_rollup(E.projects_with_area(s, d), E.tasks(s, d), E.as_of())


def day(c):
    return F.col(c).cast("string").alias(c)


def one_line(df: DataFrame) -> DataFrame:
    """A task's columns that queries show."""
    return df.select("project_id", "line_no", "assignee_id", "part_id", "status", day("due_date"))


# --- scans and sources ---------------------------------------------------------


@query
def s_2_projected_scan(s, d):
    return E.users(s, d).select("user_id", "role")


@query
def s_3_accounts(s, d):
    return E.read_filtered(E.accounts(s, d), source_system="hubspot")


@query
def s_5_opportunities(s, d):
    return E.read_filtered(E.opportunities(s, d), source_system="salesforce", stage_canonical="Proposal").select("id", "name", F.col("amount").cast("double").alias("amount"), day("close_date"))


@query
def s_6_campaigns(s, d):
    return E.read_filtered(E.campaigns(s, d), source_system=None).select("id", "source_system", "channel")


@query
def s_8_point_lookup(s, d):
    return E.point_lookup(E.opportunities(s, d), "hubspot", 7).select("id", "source_system", "stage_canonical")


@query
def s_9_linked_records_exist(s, d):
    """Links that point to a record that exists: source, type, id."""
    links = E.events(s, d).select(E.pick(E.SOURCES, F.col("event_id") % 2).alias("source_system"), (F.col("event_id") * 7 % 4000).alias("id")).distinct()
    return links.join(E.campaigns(s, d).select("id", "source_system"), ["id", "source_system"], "left_semi")


@query
def s_12_fan_out(s, d):
    parts = [E.read_filtered(E.opportunities(s, d), source_system=x) for x in E.SOURCES]
    return reduce(DataFrame.unionByName, parts).groupBy("source_system").agg(F.count(F.lit(1)).alias("n"))


@query
def s_13_first_match(s, d):
    return E.first_match(E.opportunities(s, d), E.SOURCES, 8).select("id", "source_system")


# --- filters and projections -----------------------------------------------------


@query
def f_3_in_list(s, d):
    return one_line(E.tasks(s, d).where(F.col("assignee_id").isin(1, 2, 3)))


@query
def f_6_mine_or_blocking(s, d):
    me = 5
    return one_line(E.tasks(s, d).where((F.col("assignee_id") == me) | ((F.col("blocked_by_id") == me) & (F.col("status") == "Blocked"))))


@query
def f_7_case_insensitive(s, d):
    return E.users(s, d).where(F.lower("email") == F.lower(F.lit("uSER7@example.COM"))).select("user_id", "email")


@query
def f_9_overdue(s, d):
    return one_line(E.tasks(s, d).where(X.overdue(F.col("status"), F.col("due_date"), E.as_of())))


@query
def f_10_due_soon(s, d):
    return one_line(E.tasks(s, d).where(X.due_soon(F.col("status"), F.col("due_date"), E.as_of())))


@query
def f_11_overdue_snapshot(s, d):
    return E.tasks(s, d).where(X.overdue_now(F.col("status"), F.col("due_date"), E.now())).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def f_12_active_escalation(s, d):
    return one_line(E.tasks(s, d).where(X.active_escalation(F.col("escalated_at"), F.col("escalation_resolved_at"))))


@query
def f_13_escalation_inbox(s, d):
    return one_line(E.tasks(s, d).where("escalated_to_id = 3 AND escalation_resolved_at IS NULL"))


@query
def f_14_blocked_list(s, d):
    return one_line(E.tasks(s, d).where("status = 'Blocked' AND (escalated_at IS NULL OR escalation_resolved_at IS NOT NULL)"))


@query
def f_16_completed_30d(s, d):
    return one_line(E.tasks(s, d).where((F.col("status") == "Complete") & (F.col("completed_at") >= E.now() - F.expr("INTERVAL 30 DAYS"))))


@query
def f_17_applies_breakdown(s, d):
    m, u = E.metrics(s, d), E.metric_users(s, d)
    return u.join(m, X.applies_to(F.col("applies_to"), F.col("role"))).groupBy("metric").agg(F.count(F.lit(1)).alias("users"))


@query
def f_18_applies_this_week(s, d):
    m, u = E.metrics(s, d), E.metric_users(s, d)
    return u.join(m, X.applies_this_week(F.col("applies_to"), F.col("role"))).groupBy("metric").agg(F.count(F.lit(1)).alias("users"))


@query
def f_19_effective_invitation(s, d):
    inv = E.events(s, d).select("event_id", E.pick(["pending", "accepted", "revoked"], F.col("event_id") % 3).alias("status"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    return inv.select(M.effective_invitation(F.col("status"), F.col("expires_at"), E.kpi_now()).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def f_20_audit_filter(s, d):
    return E.read_filtered(E.events(s, d), event_type="click", user_id=None).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query
def f_24_open_pipeline(s, d):
    return E.opportunities(s, d).where(~F.col("stage_canonical").isin(X.CLOSED_STAGES)).groupBy("stage_canonical").agg(F.sum(X.money("amount")).cast("double").alias("value"))


@query
def f_27_stale(s, d):
    e = E.events(s, d).groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("synced_at"))
    return e.where(X.stale(F.col("synced_at"), E.kpi_now() + F.expr("INTERVAL 6 DAYS"))).select("user_id")


@query
def p_1_wide_task(s, d):
    """J-5, J-6: names of four user roles and the project, from broadcast-sized or shuffled dimensions as Spark sees fit."""
    t = E.tasks(s, d)
    for role in ("assignee", "blocked_by", "escalated_to"):
        t = t.join(E.users(s, d).select(F.col("user_id").alias(f"{role}_id"), F.col("user_name").alias(f"{role}_name")), f"{role}_id", "left")
    t = t.join(E.projects_with_area(s, d).select("project_id", "code", "area_id"), "project_id", "left")
    status, due = F.col("status"), F.col("due_date")
    blocking = F.coalesce((F.col("blocked_by_id") == 5) & (status == "Blocked"), F.lit(False))
    return t.select(
        "project_id", "line_no", "part_id", "status", "code", "area_id", "assignee_name", "blocked_by_name", "escalated_to_name",
        X.overdue(status, due, E.as_of()).alias("is_overdue"), X.due_soon(status, due, E.as_of()).alias("is_due_soon"),
        X.active_escalation(F.col("escalated_at"), F.col("escalation_resolved_at")).alias("is_escalated"), blocking.alias("is_blocking_me"),
    )


# --- joins -------------------------------------------------------------------------


@query
def j_1_projects_areas(s, d):
    return E.projects_with_area(s, d).join(F.broadcast(E.focus_areas(s, d)), "area_id", "left").groupBy("area_id", "area_name").agg(F.count(F.lit(1)).alias("n"))


@query
def j_3_j_4_targets(s, d):
    u = E.users(s, d).select(F.col("user_id").alias("updated_by_id"), F.col("user_name").alias("updated_by"))
    return E.targets(s, d).join(E.focus_areas(s, d), "area_id").join(u, "updated_by_id", "left").select("area_id", "area_name", "target_numeric", "current_numeric", "updated_by")


@query
def j_8_nested_tasks(s, d):
    """Tasks of each project as one array, empty for projects without; shown by its size and its least due date."""
    nested = E.tasks(s, d).groupBy("project_id").agg(F.collect_list(F.struct("due_date", "line_no", "status")).alias("tasks"))
    out = E.projects(s, d).select("project_id").join(nested, "project_id", "left").withColumn("tasks", F.coalesce("tasks", F.expr("cast(array() AS array<struct<due_date:date,line_no:int,status:string>>)")))
    return out.select("project_id", F.size("tasks").cast("bigint").alias("n"), F.array_min(F.transform("tasks", lambda t: t["due_date"])).cast("string").alias("first_due"))


def spine(s, d) -> DataFrame:
    """J-12, J-13: metric, user, and the six Mondays up to the current one."""
    m, u = E.metrics(s, d), E.metric_users(s, d)
    base = u.join(m, X.applies_to(F.col("applies_to"), F.col("role")))
    return base.withColumn("period_start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.date_sub(X.monday(E.kpi_now()), k * 7))))


def filled(s, d) -> DataFrame:
    """J-14, W-4: the spine with counts, 0 where there is no entry; of duplicates the last one."""
    e = M.latest(E.metric_entries(s, d), ["metric", "user_id", "period_start"])
    return spine(s, d).join(e, ["metric", "user_id", "period_start"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))


@query
def j_14_filled_spine(s, d):
    return filled(s, d).select("metric", "user_id", day("period_start"), "count")


@query
def j_16_semi_projects(s, d):
    areas = E.projects_with_area(s, d).where("area_id = 2")
    return E.tasks(s, d).join(areas, "project_id", "left_semi").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def j_17_merge_memberships(s, d):
    """Memberships (task project as group): user 3's move to user 4, those that 4 has already go."""
    g = E.tasks(s, d).select(F.col("project_id").alias("group_id"), F.col("assignee_id").alias("user_id")).distinct()
    return M.merge_keyed(g, "user_id", ["group_id"], 3, 4).groupBy("user_id").agg(F.count(F.lit(1)).alias("groups"))


@query
def j_18_merge_entries(s, d):
    e = E.metric_entries(s, d).select("metric", "user_id", "period_start", "count")
    return M.merge_keyed(e, "user_id", ["metric", "period_start"], 3, 4).where("user_id IN (3, 4)").select("metric", "user_id", day("period_start"), "count")


@query
def j_19_audit_names(s, d):
    u = E.users(s, d).select(F.col("user_id"), F.col("user_name"))
    return M.kpi_audit(E.metric_entries(s, d)).join(u, "user_id", "left").select("metric", F.coalesce("user_name", F.col("user_id").cast("string")).alias("who"), day("period_start"), "old_count", "new_count")


@query
def j_25_polymorphic_links(s, d):
    links = E.events(s, d).select("event_id", E.pick(["opportunity", "campaign"], F.col("event_id") % 2).alias("record_type"), (F.col("event_id") % 3000).alias("id"))
    named = [links.where(F.col("record_type") == t).join(df.select("id", "name"), "id") for t, df in (("opportunity", E.opportunities(s, d)), ("campaign", E.campaigns(s, d)))]
    return named[0].unionByName(named[1])


@query
def j_26_recent_events(s, d):
    """W-1: ten latest events of each type."""
    w = Window.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return E.events(s, d).select("event_type", "event_id", "ts").withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("event_type", "event_id", "rank")


# --- aggregates -----------------------------------------------------------------------


@query
def a_1_group_counts(s, d):
    n = E.tasks(s, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("members"))
    return E.projects(s, d).select("project_id").join(n, "project_id", "left").fillna(0, ["members"])


@query
def a_2_next_order(s, d):
    return E.focus_areas(s, d).agg((F.coalesce(F.max("sort_order"), F.lit(0)) + 1).alias("next_order"))


@query
def a_3_task_breakdown(s, d):
    return A.breakdown(E.tasks(s, d))


@query
def a_4_project_rollup(s, d):
    return rollup(s, d).select("project_id", "task_count", "overdue_count", "blocked_count", "complete_count", "percent_complete", "status", "health")


@query
def a_7_portfolio(s, d):
    return A.portfolio(rollup(s, d))


@query
def a_8_area_rollup(s, d):
    return A.area_rollup(E.focus_areas(s, d), rollup_with_area(s, d)).select("area_id", "area_name", "project_count", "task_count", "percent_complete", "has_overdue")


@query
def a_9_workload(s, d):
    return A.workload(E.users(s, d), E.tasks(s, d), E.as_of())


@query
def a_10_cover(s, d):
    return A.cover(rollup(s, d))


@query
def a_11_initiatives(s, d):
    return A.initiatives(E.focus_areas(s, d), rollup_with_area(s, d), E.targets(s, d))


@query
def a_12_common_owner(s, d):
    return A.top_owner(rollup_with_area(s, d))


@query
def a_15_snapshot(s, d):
    return A.snapshot(E.focus_areas(s, d), E.projects_with_area(s, d), E.tasks(s, d), E.now())


@query
def a_17_parent_rollup(s, d):
    return A.parent_rollup(E.tasks(s, d).withColumnRenamed("project_id", "parent_id"))


@query
def a_18_pipeline(s, d):
    return A.pipeline_by_stage(E.opportunities(s, d))


@query
def a_19_pipeline_totals(s, d):
    return A.pipeline_totals(A.pipeline_by_stage(E.opportunities(s, d)))


@query
def a_20_marketing(s, d):
    return A.marketing_totals(E.campaigns(s, d))


@query
def a_21_campaign_rates(s, d):
    c = F.col
    return E.campaigns(s, d).select("id", X.percent(c("opens"), c("sends")).alias("open_rate"), X.percent(c("clicks"), c("sends")).alias("click_rate"))


def current(s, d) -> DataFrame:
    return filled(s, d).where(F.col("period_start") == X.monday(E.kpi_now()))


@query
def a_22_kpi_breakdown(s, d):
    return current(s, d).groupBy("metric").agg(F.sum("count").alias("total_actual"), F.sum("target").alias("total_target"))


@query
def a_23_kpi_team(s, d):
    by = current(s, d).groupBy("metric").agg(F.sum("count").alias("actual"), F.sum("target").alias("target"), F.count_if(F.col("count") >= F.col("target")).alias("on_target"), F.count(F.lit(1)).alias("n"))
    return by.select("metric", X.percent(F.col("actual"), F.col("target")).alias("target_percent"), "on_target", X.percent(F.col("on_target"), F.col("n")).alias("on_target_percent"))


@query
def a_24_weekly_totals(s, d):
    """Six weeks by user with a total row per metric (user_id null)."""
    out = filled(s, d).rollup("metric", "user_id").agg(F.sum("count").alias("total"), F.sum("target").alias("target")).where("metric IS NOT NULL")
    return out.select("metric", "user_id", "total", X.percent(F.col("total"), F.col("target")).alias("percent"))


@query
def a_26_people_totals(s, d):
    w = A.workload(E.users(s, d), E.tasks(s, d), E.as_of())
    return w.agg(F.sum("open").alias("open"), F.sum("overdue").alias("overdue"), F.count_if(F.col("overdue") > 0).alias("people_overdue"))


@query
def a_29_status_share(s, d):
    return A.status_share(E.tasks(s, d))


@query
def a_30_latest_sync(s, d):
    return E.events(s, d).agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query
def a_31_moved_counts(s, d):
    return M.moved_counts(E.tasks(s, d), ["assignee_id", "blocked_by_id", "escalated_to_id"], 3)


@query
def a_33_distinct(s, d):
    return E.accounts(s, d).select("type").distinct()


@query
def a_34_task_report(s, d):
    by = E.tasks(s, d).groupBy(F.coalesce(F.col("blocked_by_id").cast("string"), F.lit("—")).alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.avg("percent_complete").alias("p"))
    return by.select("dim", "n", X.round2(F.col("p")).alias("avg_percent"))


# --- report language -----------------------------------------------------------------------


def tables(s, d) -> dict[str, DataFrame]:
    return {"opportunities": E.opportunities(s, d), "campaigns": E.campaigns(s, d), "accounts": E.accounts(s, d)}


def preset(name):
    def run(s, d):
        return R.run_report(tables(s, d), R.PRESETS[name])

    return run


for _k in R.PRESETS:
    QUERIES[f"rs_17_{_k}"] = preset(_k)


@query
def rs_1_two_sources(s, d):
    return R.run_report(tables(s, d), R.Spec(["opportunities", "campaigns", "campaigns"], [R.Metric("count", label="n"), R.Metric("sum", "amount", "amount"), R.Metric("sum", "sends", "sends")], ["source", "source_system"]))


@query
def rs_2_strict_filters(s, d):
    """neq and notIn keep nulls; a number equals no decimal; a missing column differs from everything."""
    fs = [R.Filter("owner_name", "neq", "Owner 3"), R.Filter("owner_name", "notIn", ["Owner 4", "Owner 5"]), R.Filter("amount", "neq", 30000), R.Filter("nothing", "neq", None)]
    return R.run_report(tables(s, d), R.Spec(["opportunities"], [R.Metric("count", label="n")], ["owner_name"], fs))


@query
def rs_2_order_filters(s, d):
    """lt holds for nulls, which read as 0; dates read as their year."""
    fs = [R.Filter("amount", "lt", "200000 or so"), R.Filter("close_date", "gte", 1997)]
    return R.run_report(tables(s, d), R.Spec(["opportunities"], [R.Metric("avg", "amount", "mean"), R.Metric("count", label="n")], ["stage_canonical"], fs))


@query
def rs_6_no_dimensions(s, d):
    return R.run_report(tables(s, d), R.Spec(["campaigns"], [R.Metric("sum", "clicks")]))


# --- order, limits, sets --------------------------------------------------------------------


@query
def o_5_natural_order(s, d):
    """All codes in natural order, in a global sort."""
    return E.projects(s, d).select("code", X.natural_key(F.col("code")).alias("natural_key")).orderBy("natural_key", "code")


@query
def o_11_clamped_limit(s, d):
    return E.events(s, d).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(X.clamped_limit(None)).select("event_id")


@query
def o_12_page(s, d):
    """Page 3 of 25 in a total order: source, then id."""
    rank = F.array_position(F.array(*map(F.lit, E.SOURCES)), F.col("source_system"))
    return E.opportunities(s, d).orderBy(rank, "id").offset(50).limit(25).select("id", "source_system")


@query
def o_12_page_totals(s, d):
    n = F.count(F.lit(1))
    return E.opportunities(s, d).agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / 25)).alias("pages"))


@query
def so_5_difference(s, d):
    a, b = E.tasks(s, d).select(F.col("assignee_id").alias("id")).distinct(), E.users(s, d).where("is_active").select(F.col("user_id").alias("id"))
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("tasks")).unionByName(b.join(a, "id", "left_anti").withColumn("side", F.lit("users")))


@query
def so_8_all_found(s, d):
    asked = s.createDataFrame([(1,), (2,), (2,), (99999999,)], "user_id bigint")
    found = E.users(s, d).join(asked.distinct(), "user_id", "left_semi").agg(F.count(F.lit(1)).alias("found"))
    return found.select("found", (F.col("found") == 4).alias("valid"))


# --- scalars ----------------------------------------------------------------------------------


@query
def x_1_display_names(s, d):
    u = E.users(s, d)
    return u.select("user_id", X.display_name(F.col("display_name"), F.col("first_name"), F.col("last_name"), F.col("email"), F.concat(F.lit("user-000"), F.col("user_id"))).alias("shown"))


@query
def x_2_mondays(s, d):
    return E.events(s, d).select(X.monday("ts").cast("string").alias("monday")).groupBy("monday").agg(F.count(F.lit(1)).alias("n"))


@query
def x_6_week_locks(s, d):
    p = E.metric_entries(s, d).select("period_start").distinct()
    over = s.createDataFrame([("2024-01-08",)], "p string").select(F.to_date("p").alias("period_start"))
    return M.week_editable(p, over, E.kpi_now()).select(day("period_start"), "locked", "editable")


@query
def x_10_days_vs_due(s, d):
    t = E.tasks(s, d).where("completed_at IS NOT NULL")
    return t.select(X.days_vs_due(F.col("completed_at"), F.col("due_date")).alias("days")).groupBy("days").agg(F.count(F.lit(1)).alias("n"))


@query
def x_16_texts(s, d):
    p = E.campaigns(s, d)
    none = F.nullif(F.lit(""), F.lit(""))
    return p.select("id", X.notes(F.when(F.col("id") % 2 == 0, F.col("channel")), F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(none), F.col("type")).alias("notes"), X.short_label(F.col("name")).alias("label"), X.slug(F.col("name"), "c-").alias("slug"), X.initials(F.col("type")).alias("initials"))


@query
def x_20_due_colours(s, d):
    return E.tasks(s, d).select(X.due_colour(F.col("due_date"), E.as_of()).alias("colour")).groupBy("colour").agg(F.count(F.lit(1)).alias("n"))


@query
def x_29_shortfall(s, d):
    c, t = F.col("count"), F.col("target")
    return current(s, d).select("metric", "user_id", F.greatest(F.lit(0), t - c).alias("shortfall"), F.least(F.lit(100), X.percent(c, t)).alias("percent"))


# --- views -------------------------------------------------------------------------------------


@query
def v_2_needs_attention(s, d):
    late = X.overdue(F.col("status"), F.col("due_date"), E.as_of())
    t = E.tasks(s, d).where(late | (F.col("status") == "Blocked")).join(E.projects(s, d).select("project_id", "code"), "project_id", "left")
    return t.select("project_id", "line_no", "part_id", "assignee_id", F.coalesce("code", F.lit("")).alias("code"), F.when(late, "Overdue").otherwise("Blocked").alias("reason"), day("due_date"))


@query
def v_9_kpi_sparkline(s, d):
    """Six counts in order of weeks, as text, with the current count."""
    out = filled(s, d).groupBy("metric", "user_id").agg(F.array_sort(F.collect_list(F.struct("period_start", "count"))).alias("x"))
    counts = F.transform("x", lambda e: e["count"])
    return out.select("metric", "user_id", F.concat_ws(",", counts.cast("array<string>")).alias("series"), F.element_at(counts, -1).alias("current"))


@query
def v_15_drill_down(s, d):
    """Outline rows: areas (0), projects (1), tasks (2) with their counts."""
    areas = E.focus_areas(s, d).select(F.lit(0).alias("level"), F.col("area_name").alias("label"))
    projects = E.projects_with_area(s, d).where("area_id IS NOT NULL").select(F.lit(1).alias("level"), F.col("code").alias("label"))
    tasks = E.tasks(s, d).select(F.lit(2).alias("level"), F.concat_ws("/", F.col("project_id").cast("string"), F.col("line_no").cast("string")).alias("label"))
    return areas.unionByName(projects).unionByName(tasks).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first_label"))


@query
def v_17_weekly_sheet(s, d):
    """Pivot to six weeks."""
    weeks = F.datediff(X.monday(E.kpi_now()), F.col("period_start")) / 7
    out = filled(s, d).withColumn("w", weeks.cast("int")).groupBy("metric", "user_id").pivot("w", list(range(6))).agg(F.sum("count"))
    return out.select("metric", "user_id", *(F.col(str(k)).alias(f"week_{k}") for k in range(6)))


# --- maintenance and policy ---------------------------------------------------------------------


@query
def k_7_conditional_update(s, d):
    out = M.update(E.tasks(s, d), (F.col("status") == "Blocked") & (F.col("due_date") < E.as_of()), status=F.lit("Pending Review"))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def k_9_cascade(s, d):
    gone = E.projects_with_area(s, d).where("area_id = 1")
    return M.cascade(E.tasks(s, d), gone, "project_id").groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


@query
def k_10_upsert(s, d):
    e = E.metric_entries(s, d).select("metric", "user_id", "period_start", "count")
    new = e.where("user_id % 10 = 0").withColumn("count", F.col("count") + 100).unionByName(e.where("user_id % 10 = 1").withColumn("user_id", F.col("user_id") + 100000))
    return M.upsert(e, new, ["metric", "user_id", "period_start"]).select("metric", "user_id", day("period_start"), "count")


@query
def k_11_insert_missing(s, d):
    old = E.accounts(s, d).where("id % 2 = 0").select("id", "type")
    return M.insert_missing(old, E.accounts(s, d).select("id", F.upper("name").alias("type")), ["id"])


@query
def k_12_replace_set(s, d):
    g = E.users(s, d).select((F.col("user_id") % 5).alias("group_id"), "user_id")
    return M.replace_set(g, "group_id", 2, s.createDataFrame([(2, 1), (2, 9)], "group_id bigint, user_id bigint"))


@query
def m_1_merge_users(s, d):
    t = M.merge_references(E.tasks(s, d), ["assignee_id", "blocked_by_id", "escalated_to_id"], 3, 4)
    return t.groupBy("assignee_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("blocked_by_id") == 4).alias("blocked_by_survivor"))


@query
def m_2_bulk_assign(s, d):
    links = s.createDataFrame([("a",), ("b",)], "url string")
    _, out = M.bulk_assign(E.users(s, d).where("is_active"), links, "do it", E.as_of())
    return out


@query
def m_3_gate_completion(s, d):
    asked = F.when(F.col("status") == "In Progress", "Complete")
    return M.gate_completion(E.tasks(s, d), asked, False, E.now()).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("completed_at").alias("stamped"))


@query
def m_4_escalation_target(s, d):
    return M.escalation_target(E.users(s, d), F.lit(5), F.lit(2)).select("user_id", "role")


@query
def m_4_resolve(s, d):
    return M.resolve_escalations(E.tasks(s, d), F.col("escalated_to_id") == 3, F.lit(7).cast("bigint"), E.now()).groupBy("assignee_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def m_6_kpi_audit(s, d):
    return M.kpi_audit(E.metric_entries(s, d)).select("metric", "user_id", day("period_start"), "old_count", "new_count")


@query
def r_2_viewer_tasks(s, d):
    """A member sees own and blocking tasks only; everyone else all of them."""
    seen = lambda viewer, role: F.lit(True) if role != "member" else (F.col("assignee_id") == viewer) | (F.col("blocked_by_id") == viewer)
    parts = [E.tasks(s, d).where(seen(v, r)).select(F.lit(r).alias("role"), F.lit(v).cast("bigint").alias("viewer"), "status") for v, r in ((6, "member"), (2, "admin"))]
    return parts[0].unionByName(parts[1]).groupBy("role", "viewer", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def st_1_weekly_windows(s, d):
    """Tumbling Monday weeks."""
    return E.events(s, d).groupBy(F.window("ts", "7 days", "7 days", "4 days").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").cast("string").alias("week"), "event_type", "n")
