"""Stateful rules, data sources, pages and merges: queries that need more than one declarative plan, each beside its DuckDB SQL.

Each takes (spark, sf_dir) and reads whole tables. Those that run a stream or write a table first return what they wrote.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import drift as V
from ..operators import incremental as I
from ..operators import maintain as M
from ..operators import merges as G
from ..operators import pages as P
from ..operators import report as R
from ..operators import taskedits as TE
from ..operators import tree as T
from ..sources import crm
from ..sources import entities as E
from ..sources import sinks
from ..streaming import edits as D
from ..streaming import keyed as K
from . import views
from . import whole as W
from .catalog import day, rollup_with_area
from .oracle import ACTIVE, ASOF, BASE, NOW, ROLE

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(sql: str, base: bool = True):
    """sql may begin with further table expressions, after a comma; without base it is whole."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {BASE} {sql}" if base else sql
        return f

    return add


# --- streams ------------------------------------------------------------------------------


def hits(events: DataFrame) -> DataFrame:
    """Events as requests of ten clients."""
    ts = F.col("ts").cast("timestamp")
    return events.select("event_id", (F.col("user_id") % 10).alias("client"), F.unix_micros(ts).alias("at"), ts.alias("ts"))


def played(s, d, name: str, of, flow) -> DataFrame:
    """What a stream over events gives when it is played to its end."""
    path = sinks.new_folder(s, name)
    out = flow(of(E.event_stream(K.with_state_store(s), d)))
    out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(out.schema).parquet(f"{path}/rows")


LIMIT = """WITH RECURSIVE hits AS (SELECT event_id, user_id % 10 AS client, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n FROM events),
f(client, n, event_id, us, admitted, held) AS (SELECT client, n, event_id, us, true, [us] FROM hits WHERE n = 1
  UNION ALL SELECT client, n, event_id, us, len(k) < 5, CASE WHEN len(k) < 5 THEN list_append(k, us) ELSE k END
  FROM (SELECT h.client, h.n, h.event_id, h.us, list_filter(f.held, lambda t: h.us - t < 3600000000) AS k FROM f JOIN hits h ON h.client = f.client AND h.n = f.n + 1))
SELECT event_id, client, admitted FROM f"""


@query(LIMIT, base=False)
def st_4_rate_limit(s, d):
    """Five requests of a client an hour; rejected ones don't count."""
    return K.rate_limit(hits(E.events(s, d)).drop("ts"), "client", "at", "event_id").select("event_id", "client", "admitted")


@query(LIMIT, base=False)
def st_4_rate_limit_stream(s, d):
    """The same as a stream with keyed state."""
    return played(s, d, "limits", hits, K.rate_limit_stream).select("event_id", "client", "admitted")


def touches(events: DataFrame) -> DataFrame:
    """Events as uses of a session of each user and type."""
    ts = F.col("ts").cast("timestamp")
    return events.select(F.concat_ws("-", "user_id", "event_type").alias("sid"), F.unix_micros(ts).alias("at"), ts.alias("ts"))


SESSIONS = """WITH t AS (SELECT user_id || '-' || event_type AS sid, epoch_us(ts) AS us FROM events),
b AS (SELECT *, coalesce(CAST(us > lag(us) OVER (PARTITION BY sid ORDER BY us) + 604800000000 AS INTEGER), 1) AS begins FROM t),
n AS (SELECT *, sum(begins) OVER (PARTITION BY sid ORDER BY us) AS n FROM b),
e AS (SELECT sid, min(us) AS started_at, max(us) + 604800000000 AS expired_at, count(*) AS touches FROM n GROUP BY sid, n)"""


@query(f"{SESSIONS} SELECT * FROM e", base=False)
def st_5_sessions(s, d):
    """Sessions that end seven days after their last use."""
    return K.sessions(touches(E.events(s, d)), "sid", "at")


@query(f"{SESSIONS} SELECT * FROM e WHERE expired_at < (SELECT max(us) FROM t)", base=False)
def st_5_expired_stream(s, d):
    """The same as a stream: those that have ended by the newest event."""
    return played(s, d, "sessions", touches, K.session_stream)


def edited(events: DataFrame) -> DataFrame:
    """Events as edits of their week or of one of the two before; each tenth is sent again a minute later."""
    ts = F.col("ts").cast("timestamp")
    sent = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(60))).otherwise(F.array(F.lit(0)))
    one = events.select("event_id", ts.alias("ts"), F.explode(sent).alias("later"))
    return one.select(F.col("event_id").alias("edit_id"), F.date_sub(X.monday("ts"), (F.col("event_id") % 3 * 7).cast("int")).alias("period_start"), (F.col("ts") + F.make_dt_interval(secs=F.col("later"))).alias("at"))


def overrides(s) -> DataFrame:
    return s.createDataFrame([("2024-01-08",)], "p string").select(F.to_date("p").alias("period_start"))


EDITS = """WITH e AS (SELECT event_id AS edit_id, CAST(date_trunc('week', ts) AS DATE) - CAST(event_id % 3 * 7 AS INTEGER) AS period_start, ts AS "at", 0 AS later FROM events),
r AS (SELECT * FROM e UNION ALL SELECT edit_id, period_start, "at" + INTERVAL 1 MINUTE, 1 FROM e WHERE edit_id % 10 = 0)
SELECT edit_id, CAST(period_start AS VARCHAR) AS period_start, strftime("at", '%Y-%m-%d %H:%M:%S') AS "at",
  CASE WHEN later = 1 THEN 'duplicate' WHEN period_start < CAST(date_trunc('week', "at") AS DATE) AND "at" >= date_trunc('week', "at") + INTERVAL 9 HOUR AND period_start <> DATE '2024-01-08' THEN 'locked' END AS reason FROM r"""


def shown_edits(df: DataFrame) -> DataFrame:
    return df.select("edit_id", F.col("period_start").cast("string").alias("period_start"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "reason")


@query(EDITS, base=False)
def st_2_edits(s, d):
    """Every edit with the reason why it is rejected, null if it isn't: a week is locked from the next Monday, 09:00, unless it has an override."""
    return shown_edits(D.first_of_each(D.judged(edited(E.events(s, d)), overrides(s))))


@query(EDITS, base=False)
def st_2_edit_stream(s, d):
    """The same as a stream into one table of accepted and rejected edits."""
    path = sinks.new_folder(s, "edits")
    stream = edited(E.event_stream(s, d))
    D.edits_into(stream, overrides(s), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return shown_edits(s.read.parquet(f"{path}/rows"))


# --- the connector seam --------------------------------------------------------------------


def of_all(s, d, listed) -> DataFrame:
    return reduce(DataFrame.unionByName, [listed(crm.Adapter(s, d, x)) for x in crm.SYSTEMS])


@query("SELECT id, source_system, name, account_id, owner_name, CAST(amount AS DOUBLE) AS amount, stage_canonical, CAST(close_date AS VARCHAR) AS close_date FROM opps WHERE stage_canonical = 'Proposal'")
def s_11_list_opportunities(s, d):
    """Both systems' opportunities of a stage, by the data source."""
    out = of_all(s, d, lambda a: a.opportunities("Proposal"))
    return out.withColumns({"amount": F.col("amount").cast("double"), "close_date": F.col("close_date").cast("string")})


@query("SELECT id, source_system, name, channel, type, sends, opens, clicks, CAST(influenced_pipeline AS DOUBLE) AS influenced_pipeline FROM camps")
def s_11_list_campaigns(s, d):
    return of_all(s, d, lambda a: a.campaigns()).withColumn("influenced_pipeline", F.col("influenced_pipeline").cast("double"))


@query("SELECT event_id AS id, (['salesforce', 'hubspot'])[event_id % 2 + 1] AS source_system, event_id % 200 AS campaign_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS sent_at FROM events WHERE event_id % 200 = 7")
def s_11_list_email_activity(s, d):
    return of_all(s, d, lambda a: a.email_activity(7)).withColumn("sent_at", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT id, source_system, name, stage_canonical FROM opps WHERE id = 7 AND source_system = 'hubspot'")
def s_11_get_opportunity(s, d):
    return crm.Adapter(s, d, "hubspot").opportunity(7).select("id", "source_system", "name", "stage_canonical")


# --- reports over one scan ------------------------------------------------------------------


@query(
    "SELECT 'pipeline_by_stage' AS report, stage_canonical AS dim, CAST(sum(coalesce(amount, 0)) AS DOUBLE) AS value FROM opps GROUP BY 2 UNION ALL SELECT 'pipeline_by_source', source_system, CAST(sum(coalesce(amount, 0)) AS DOUBLE) FROM opps GROUP BY 2 "
    "UNION ALL SELECT 'open_by_owner', owner_name, CAST(count(*) AS DOUBLE) FROM opps WHERE stage_canonical NOT IN ('Closed Won', 'Closed Lost') GROUP BY 2 UNION ALL SELECT 'influenced_pipeline', channel, CAST(sum(coalesce(influenced_pipeline, 0)) AS DOUBLE) FROM camps GROUP BY 2"
)
def rs_17_presets(s, d):
    """The four presets, each source read once."""
    tables = {"opportunities": E.opportunities(s, d), "campaigns": E.campaigns(s, d)}
    return R.run_reports(tables, R.PRESETS).select("report", F.get("dims", F.lit(0)).alias("dim"), F.get("metrics", F.lit(0)).alias("value"))


# --- pages and orders ------------------------------------------------------------------------


def paged(s, df: DataFrame, columns: list[str]) -> P.Pages:
    return P.Pages.write(df, columns, sinks.new_folder(s, "pages"), int(s.conf.get("spark.sql.shuffle.partitions")))


def ranked_opportunities(s, d) -> P.Pages:
    """By source, then by id."""
    o = E.opportunities(s, d).select("id", "source_system", "owner_name")
    return paged(s, o.withColumn("rank", F.when(F.col("source_system") == E.SOURCES[0], 0).otherwise(1)), ["rank", "id"])


@query("SELECT id, source_system FROM opps ORDER BY source_system = 'hubspot', id LIMIT 25 OFFSET 50")
def o_12_seek_page(s, d):
    """The third page, by the token of the second's last row."""
    p = ranked_opportunities(s, d)
    walk = p.walk()
    next(walk)
    return p.page(token=P.token_of(next(walk)[-1], p.columns)).select("id", "source_system")


@query("SELECT id, owner_name FROM opps ORDER BY owner_name NULLS LAST, id LIMIT 40 OFFSET (SELECT count(owner_name) FROM opps) - 20")
def o_12_seek_into_nulls(s, d):
    """A page that begins twenty rows before the opportunities without owner."""
    p = paged(s, E.opportunities(s, d).select("id", "owner_name"), ["owner_name", "id"])
    last = p.rows().where("owner_name IS NOT NULL").orderBy(F.col("owner_name").desc(), F.col("id").desc()).limit(21).collect()[-1]
    return p.page(40, P.token_of(last, p.columns)).select("id", "owner_name")


@query("SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 25) AS BIGINT)) AS pages FROM opps")
def v_20_page_totals(s, d):
    """From the manifest alone."""
    return ranked_opportunities(s, d).totals()


@query("SELECT area_id, sort_order, project_id, code FROM projects LEFT JOIN areas USING (area_id)")
def o_2_all_projects(s, d):
    """All projects by their area's order, then by id; those of no area last."""
    areas = E.focus_areas(s, d).select("area_id", "sort_order")
    out = E.projects_with_area(s, d).join(areas, "area_id", "left").select("area_id", "sort_order", "project_id", "code")
    return out.orderBy(F.col("sort_order").asc_nulls_last(), "project_id")


# --- a batch of identity merges ----------------------------------------------------------------

#: source, target, position: 4 goes into 5, which goes into 6.
MERGES = [(4, 5, 1), (5, 6, 2), (8, 6, 3), (7, 9, 4)]


def referring(s, d) -> tuple[dict, dict]:
    """The tables with their nineteen user columns, and the two keyed ones, as far as the star schema feeds them."""
    t, i, r = E.tasks(s, d).selectExpr("*", *W.MORE_IDS.split(", ")), E.invitations(s, d), E.access_requests(s, d)
    entries = E.metric_entries(s, d).select("metric", "user_id", "period_start", "count")
    week = F.dayofyear("period_start").cast("bigint")
    return {
        "tasks": (t, ["assignee_id", "blocked_by_id", "escalated_to_id", "escalated_by_id", "original_assignee_id", "resolved_by_id"]),
        "task_attachments": (t.where("part_id % 5 = 0").select("project_id", "line_no", "part_id", F.col("assignee_id").alias("added_by_id")), ["added_by_id"]),
        "groups": (E.group_members(s, d).select("group_id", (F.col("group_id") + 3).alias("created_by_id")).distinct(), ["created_by_id"]),
        "kpi_audit_entries": (M.kpi_audit(entries).withColumn("changed_by_id", F.col("user_id") % 7 + 1), ["user_id", "changed_by_id"]),
        "week_lock_overrides": (entries.select("period_start").distinct().withColumn("unlocked_by_id", week % 5 + 4), ["unlocked_by_id"]),
        "focus_area_targets": (E.targets(s, d), ["updated_by_id"]),
        "projects": (E.projects(s, d).withColumn("executive_owner_id", F.col("owner_id") % 20 + 1), ["executive_owner_id"]),
        "invitations": (i.withColumns({"created_by_id": F.col("id") % 9 + 1, "accepted_by_user_id": F.when(F.col("status") == "accepted", F.col("target_user_id"))}), ["target_user_id", "created_by_id", "accepted_by_user_id"]),
        "audit_log": (E.events(s, d).select("event_id", F.col("user_id").alias("actor_id")), ["actor_id"]),
        "access_requests": (r, ["requester_user_id", "decided_by_id"]),
    }, {"group_members": (t.select(F.col("project_id").alias("group_id"), F.col("assignee_id").alias("user_id")).distinct(), "user_id", ["group_id"]), "metric_entries": (entries, "user_id", ["metric", "period_start"])}


def merged(s, d) -> G.Merged:
    key = F.col("user_id")
    logins = {"auth_subject": F.when(key % 2 == 0, F.concat(F.lit("s"), key)), "password_hash": F.when(key % 3 == 2, F.concat(F.lit("h"), key)), "password_set_at": F.when(key % 3 == 2, F.concat(F.lit("at"), key)), "profile_image_url": F.when(key % 4 == 0, F.concat(F.lit("i"), key))}
    users = E.users(s, d).select("user_id", "is_active", "email").withColumns(logins)
    refs, keyed = referring(s, d)
    merges = s.createDataFrame(MERGES, "source bigint, target bigint, position int")
    return G.merge_batch(users, merges, refs, keyed, [("password_hash", "password_set_at"), ("email",), ("auth_subject",), ("profile_image_url",)], ["email", "auth_subject", "password_hash", "password_set_at"])


# rank: the order in which rows of accounts with one root stay; the root's own is 0.
ROOTS = ", roots AS (SELECT * FROM (VALUES (5, 6, 1), (4, 6, 2), (8, 6, 3), (7, 9, 1)) v(user_id, root, rank))"
TO = lambda c: f"coalesce((SELECT root FROM roots WHERE roots.user_id = {c}), {c})"
MEMBERS = "(SELECT DISTINCT project_id AS group_id, assignee_id AS user_id FROM tasks)"


def kept_rows(table: str, keys: str) -> str:
    """Rows of a keyed table that stay, with their root and rank."""
    return f"(SELECT x.*, coalesce(root, x.user_id) AS owner, coalesce(rank, 0) AS rank FROM {table} x LEFT JOIN roots ON roots.user_id = x.user_id QUALIFY coalesce(rank, 0) = min(coalesce(rank, 0)) OVER (PARTITION BY coalesce(root, x.user_id), {keys}))"


COUNTED = {
    **{f"tasks.{c}": (f"(SELECT *, {W.MORE_IDS} FROM tasks)", c) for c in ("assignee_id", "blocked_by_id", "escalated_to_id", "escalated_by_id", "original_assignee_id", "resolved_by_id")},
    "task_attachments.added_by_id": ("(SELECT * FROM tasks WHERE part_id % 5 = 0)", "assignee_id"), "groups.created_by_id": ("(SELECT DISTINCT user_id % 5 + 3 AS c FROM users)", "c"),
    "kpi_audit_entries.user_id": ("(SELECT * FROM audit WHERE old_count IS NULL OR old_count <> new_count)", "user_id"), "kpi_audit_entries.changed_by_id": ("(SELECT user_id % 7 + 1 AS c FROM audit WHERE old_count IS NULL OR old_count <> new_count)", "c"),
    "week_lock_overrides.unlocked_by_id": ("(SELECT dayofyear(period_start) % 5 + 4 AS c FROM (SELECT DISTINCT period_start FROM entries))", "c"), "focus_area_targets.updated_by_id": ("targets", "updated_by_id"),
    "projects.executive_owner_id": ("(SELECT owner_id % 20 + 1 AS c FROM projects)", "c"), "invitations.target_user_id": ("events", "user_id"), "invitations.created_by_id": ("(SELECT event_id % 9 + 1 AS c FROM events)", "c"),
    "invitations.accepted_by_user_id": ("(SELECT user_id AS c FROM events WHERE event_id % 3 = 1)", "c"), "audit_log.actor_id": ("events", "user_id"), "access_requests.requester_user_id": ("events", "user_id"), "access_requests.decided_by_id": ("(SELECT user_id AS c FROM events WHERE event_id % 3 <> 0)", "c"),
}


@query(
    ROOTS + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS column_name, count(*) AS moved FROM {table} t WHERE t.{c} IN (SELECT user_id FROM roots)" for name, (table, c) in COUNTED.items())
    + f" UNION ALL SELECT 'group_members.user_id', count(*) FROM {kept_rows(MEMBERS, 'group_id')} WHERE rank > 0 UNION ALL SELECT 'metric_entries.user_id', count(*) FROM {kept_rows('entries', 'metric, period_start')} WHERE rank > 0) WHERE moved > 0"
)
def m_1_batch_counts(s, d):
    """How many references of each of the 21 columns moved."""
    return merged(s, d).moved()


@query(f"{ROOTS} SELECT project_id, line_no, part_id, " + ", ".join(f"{TO('t.' + c)} AS {c}" for c in W.ROLES) + f" FROM (SELECT *, {W.MORE_IDS} FROM tasks) t")
def m_1_batch_tasks(s, d):
    return merged(s, d).tables["tasks"].select("project_id", "line_no", "part_id", *W.ROLES)


@query(f"{ROOTS} SELECT metric, owner AS user_id, CAST(period_start AS VARCHAR) AS period_start, count FROM {kept_rows('entries', 'metric, period_start')}")
def m_1_batch_entries(s, d):
    return merged(s, d).tables["metric_entries"].select("metric", "user_id", F.col("period_start").cast("string").alias("period_start"), "count")


@query(f"{ROOTS} SELECT group_id, owner AS user_id FROM {kept_rows(MEMBERS, 'group_id')}")
def m_1_batch_members(s, d):
    return merged(s, d).tables["group_members"].select("group_id", "user_id")


OWN = "SELECT u.user_id, is_active, email, CASE WHEN u.user_id % 2 = 0 THEN 's' || u.user_id END AS auth_subject, CASE WHEN u.user_id % 3 = 2 THEN 'h' || u.user_id END AS password_hash, CASE WHEN u.user_id % 3 = 2 THEN 'at' || u.user_id END AS password_set_at, CASE WHEN u.user_id % 4 = 0 THEN 'i' || u.user_id END AS profile_image_url FROM users u"


@query(f"""{ROOTS}, own AS ({OWN}), theirs AS (SELECT root AS user_id, {", ".join(f"arg_min({c}, rank) FILTER ({k} IS NOT NULL) AS {c}" for c, k in (("email", "email"), ("auth_subject", "auth_subject"), ("password_hash", "password_hash"), ("password_set_at", "password_hash"), ("profile_image_url", "profile_image_url")))} FROM own JOIN roots USING (user_id) GROUP BY 1)
  SELECT o.user_id, CASE WHEN r.root IS NOT NULL THEN false WHEN t.user_id IS NOT NULL THEN true ELSE is_active END AS is_active, {", ".join(f"CASE WHEN r.root IS NULL THEN coalesce(o.{c}, t.{c}) END AS {c}" for c in ("email", "auth_subject", "password_hash", "password_set_at"))}, coalesce(o.profile_image_url, t.profile_image_url) AS profile_image_url
  FROM own o LEFT JOIN roots r ON r.user_id = o.user_id LEFT JOIN theirs t ON t.user_id = o.user_id""")
def m_1_batch_users(s, d):
    return merged(s, d).users


# --- nested trees ------------------------------------------------------------------------------


def nodes(s, d) -> DataFrame:
    return T.project_nodes(rollup_with_area(s, d), E.tasks(s, d), W.shown_users(s, d), E.as_of())


TASK = f"""{{'id': t.project_id || '/' || line_no || '/' || part_id, 'assignee_id': t.assignee_id, 'assignee': coalesce({W.SHOWN}, CAST(t.assignee_id AS VARCHAR)), 'status': t.status, 'priority': priority, 'percent_complete': percent_complete,
  'due_date': CAST(due_date AS VARCHAR), 'is_overdue': coalesce(t.status <> 'Complete' AND due_date < {ASOF}, false), 'completed_at': strftime(completed_at, '%Y-%m-%d %H:%M:%S')}}"""
NODES = f""", tt AS (SELECT t.project_id, list({TASK} ORDER BY due_date, line_no, part_id, t.assignee_id, percent_complete, t.status) AS tasks FROM tasks t LEFT JOIN users ON user_id = t.assignee_id GROUP BY 1),
nodes AS (SELECT r.area_id, r.project_id, r.code, n, late, s, {{'project_id': r.project_id, 'code': r.code, 'owner_name': c_name, 'status': r.status, 'health': health, 'percent_complete': pct, 'task_count': n, 'overdue_count': late, 'blocked_count': b, 'tasks': coalesce(tasks, [])}} AS node
  FROM rollup_ r LEFT JOIN tt ON tt.project_id = r.project_id LEFT JOIN customer ON c_custkey = r.owner_id)"""


@query(f"{NODES} SELECT project_id, area_id, CAST(to_json(node) AS VARCHAR) AS node FROM nodes")
def v_7_project_nodes(s, d):
    """Each project with its tasks nested, as JSON."""
    return nodes(s, d).select("project_id", "area_id", T.json_text(F.col("node")).alias("node"))


@query(f"""{NODES} SELECT a.area_id, CAST(to_json({{'area_id': a.area_id, 'area_name': any_value(area_name), 'percent_complete': CASE WHEN coalesce(sum(n), 0) = 0 THEN 0 ELSE CAST(floor(sum(s) / sum(n) + 0.5) AS BIGINT) END, 'project_count': count(project_id),
  'task_count': CAST(coalesce(sum(n), 0) AS BIGINT), 'overdue_count': CAST(coalesce(sum(late), 0) AS BIGINT), 'target': any_value(CASE WHEN t.area_id IS NOT NULL THEN {{'target_numeric': target_numeric, 'current_numeric': current_numeric}} END),
  'projects': coalesce(list(node ORDER BY 'P' || lpad(CAST(project_id % 7 + 1 AS VARCHAR), 20, '0') || '-' || lpad(CAST(project_id AS VARCHAR), 20, '0')) FILTER (project_id IS NOT NULL), [])}}) AS VARCHAR) AS tree
  FROM areas a LEFT JOIN nodes USING (area_id) LEFT JOIN targets t ON t.area_id = a.area_id GROUP BY 1""")
def v_7_report_tree_nested(s, d):
    """Each area with its projects and their tasks nested, as JSON."""
    return T.tree_texts(E.focus_areas(s, d), E.targets(s, d), nodes(s, d))


# --- drift of a catalogue ------------------------------------------------------------------------

#: What is expected of the catalogue, against what it holds: a table, a column and an index too many or too few, two types and a default.
EXPECTED = {t: c for t, c in W.DECLARED.items() if t != "events"} | {
    "orders": W.DECLARED["orders"].replace("o_totalprice double", "o_totalprice decimal(12,2)") + ", o_comment string",
    "customer": W.DECLARED["customer"].replace(", c_mktsegment string", ""), "shipments": "s_id bigint",
}
EXPECTED_MORE = [("lineitem", "index", "by_order", "l_orderkey,l_linenumber"), ("lineitem", "index", "by_part", "l_partkey"), ("orders", "unique", "one", "o_orderkey"), ("orders", "foreign key", "buyer", "o_custkey -> customer(c_custkey)"), ("part", "not null", "p_partkey", "true"), ("shipments", "index", "gone", "s_id")]
LIVE_MORE = {"lineitem": {"index.by_order": "unique l_orderkey,l_linenumber", "index.by_supplier": "l_suppkey"}, "orders": {"unique.one": "o_orderkey", "foreign.buyer": "o_custkey -> customer(c_custkey) on delete cascade"}, "events": {"index.by_time": "ts"}}


def catalogued(s, d) -> str:
    """A database whose external tables are the star schema's files."""
    name = f"cadenza_live_{sinks.new_folder(s, 'x').rsplit('-', 1)[1]}"
    s.sql(f"CREATE DATABASE {name}")
    for t in W.DECLARED:
        said = ", ".join(f"'{k}' = '{v}'" for k, v in LIVE_MORE.get(t, {}).items())
        s.sql(f"CREATE TABLE {name}.{t} USING parquet LOCATION '{d}/{t}.parquet'" + (f" TBLPROPERTIES ({said})" if said else ""))
    return name


def expected_facts(s) -> DataFrame:
    facts = [(t, "table", "", "parquet") for t in EXPECTED] + [(t, "column", *c.split(" ", 1)) for t, ddl in EXPECTED.items() for c in ddl.split(", ")]
    return s.createDataFrame(facts + EXPECTED_MORE, V.FACTS)


DUCK = {"int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "bigint": "BIGINT", "double": "DOUBLE"}
LIVE_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, column_type FROM (DESCRIBE {t})" for t in W.DECLARED)
TYPES = " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in DUCK.items())


@query(f"""WITH l AS (SELECT table_name, column_name, CASE column_type {TYPES} END AS live FROM ({LIVE_SQL})), e AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{c.split(' ', 1)[0]}', '{c.split(' ', 1)[1]}')" for t, ddl in EXPECTED.items() for c in ddl.split(", "))}) v(table_name, column_name, expected)),
c AS (SELECT coalesce(e.table_name, l.table_name) AS table_name, coalesce(e.column_name, l.column_name) AS column_name, expected, live FROM e FULL JOIN l ON e.table_name = l.table_name AND e.column_name = l.column_name)
SELECT CASE WHEN live IS NULL THEN 'missing columns' WHEN expected IS NULL THEN 'extra columns' ELSE 'column mismatches' END AS list, 'column' AS kind, table_name || '.' || column_name AS item, expected, live, true AS failure
  FROM c WHERE expected IS DISTINCT FROM live AND table_name IN (SELECT table_name FROM e) AND table_name IN (SELECT table_name FROM l)
UNION ALL SELECT 'missing tables', 'table', t, 'parquet', NULL, true FROM (SELECT DISTINCT table_name AS t FROM e) WHERE t NOT IN (SELECT table_name FROM l) UNION ALL SELECT 'extra tables', 'table', t, NULL, 'parquet', false FROM (SELECT DISTINCT table_name AS t FROM l) WHERE t NOT IN (SELECT table_name FROM e)
UNION ALL SELECT * FROM (VALUES ('index mismatches', 'index', 'lineitem.by_order', 'l_orderkey,l_linenumber', 'unique l_orderkey,l_linenumber', true), ('missing indexes', 'index', 'lineitem.by_part', 'l_partkey', NULL, true), ('extra indexes', 'index', 'lineitem.by_supplier', NULL, 'l_suppkey', false),
  ('foreign key mismatches', 'foreign key', 'orders.buyer', 'o_custkey -> customer(c_custkey)', 'o_custkey -> customer(c_custkey) on delete cascade', true), ('column mismatches', 'not null', 'part.p_partkey', 'true', NULL, true))""", base=False)
def v_30_drift_lists(s, d):
    """The lists of a drift report: the star schema's files, catalogued, against what is expected of them."""
    name = catalogued(s, d)
    live = V.scan(s, name)
    s.sql(f"DROP DATABASE {name} CASCADE")  # external tables: their files stay
    return V.drift(expected_facts(s), live)


# --- rollups and upserts in buckets ----------------------------------------------------------------

CHANGED = f"""(SELECT * REPLACE (CASE WHEN part_id % 50 = 0 THEN 'Complete' ELSE status END AS status, CASE WHEN part_id % 50 = 0 THEN 100 ELSE percent_complete END AS percent_complete) FROM tasks WHERE part_id % 70 <> 1 OR part_id % 50 = 0
  UNION ALL SELECT * REPLACE (line_no + 100 AS line_no) FROM tasks WHERE part_id % 90 = 2)"""


@query(f"SELECT project_id, count(*) AS task_count, count(*) FILTER (status <> 'Complete' AND due_date < {ASOF} + 30) AS overdue_count, count(*) FILTER (status = 'Blocked') AS blocked_count, count(*) FILTER (status = 'Complete') AS complete_count, count(*) FILTER (status IN {ACTIVE}) AS active_count, CAST(sum(percent_complete) AS BIGINT) AS percent_sum FROM {CHANGED} GROUP BY 1")
def st_3_incremental_rollup(s, d):
    """Task counts by project after edits, deletions, insertions and thirty more days, from deltas alone."""
    t, by = E.tasks(s, d), ["project_id"]
    state = I.rollup_state(s, sinks.new_folder(s, "rollup"), [("project_id", "bigint")])
    I.apply_delta(state, I.delta(None, t, by, E.as_of()), 0)
    done = F.col("part_id") % 50 == 0
    edited_ = t.where(done)
    I.apply_delta(state, I.delta(edited_, edited_.withColumns({"status": F.lit("Complete"), "percent_complete": F.lit(100)}), by, E.as_of()), 1)
    I.apply_delta(state, I.delta(t.where((F.col("part_id") % 70 == 1) & ~done), t.where(F.col("part_id") % 90 == 2), by, E.as_of()), 2)
    now = M.update(t, done, status=F.lit("Complete")).where((F.col("part_id") % 70 != 1) | done).unionByName(t.where(F.col("part_id") % 90 == 2))
    I.apply_delta(state, I.grown_older(now, by, E.as_of(), F.date_add(E.as_of(), 30)), 3)
    return state.read()


@query("SELECT metric, user_id, CAST(period_start AS VARCHAR) AS period_start, count + CASE WHEN user_id % 10 = 0 THEN 100 ELSE 0 END AS count FROM entries UNION ALL SELECT metric, user_id + 100000, CAST(period_start AS VARCHAR), count FROM entries WHERE user_id % 10 = 1")
def k_10_bucket_upsert(s, d):
    """Entries of each tenth user raised and others added, in the buckets that they touch."""
    e = E.metric_entries(s, d).select("metric", "user_id", "period_start", "count")
    table = I.Buckets(s, sinks.new_folder(s, "entries"), ["metric", "user_id", "period_start"], e.schema)
    table.upsert(e, epoch=0)
    more = e.where("user_id % 10 = 0").withColumn("count", F.col("count") + 100).unionByName(e.where("user_id % 10 = 1").withColumn("user_id", F.col("user_id") + 100000))
    table.upsert(more, epoch=1)
    return table.read().withColumn("period_start", F.col("period_start").cast("string"))


# --- task updates, audit values, the workbook -------------------------------------------------------


def grouped_tasks(s, d) -> DataFrame:
    """Every task as the child of a group parent of its project."""
    t = E.tasks(s, d)
    stamp = F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at")
    child = t.select(F.concat_ws("/", "project_id", "line_no", "part_id", "assignee_id").alias("task_id"), F.concat(F.lit("P"), "project_id").alias("parent_task_id"), F.lit(False).alias("is_group_parent"), "assignee_id", "status", "percent_complete", day("due_date"), F.lit("do").alias("description"), stamp)
    none = lambda t: F.lit(None).cast(t)
    parent = E.projects(s, d).select(F.concat(F.lit("P"), "project_id").alias("task_id"), none("string").alias("parent_task_id"), F.lit(True).alias("is_group_parent"), F.col("owner_id").alias("assignee_id"), F.lit("Not Started").alias("status"), F.lit(0).alias("percent_complete"), none("string").alias("due_date"), F.lit("group").alias("description"), none("string").alias("completed_at"))
    return child.unionByName(parent)


def task_patches(s, d) -> DataFrame:
    """Statuses of each sixth part's tasks by all roles, hand-overs by members, new dates and descriptions of each tenth project; one patch of no task."""
    t, part, nothing = E.tasks(s, d), F.col("part_id"), F.lit(None).cast("string")
    key = F.concat_ws("/", "project_id", "line_no", "part_id", "assignee_id").alias("task_id")
    role = E.pick(E.ROLES, part % 5)
    row = lambda *given, **new: (F.array(*map(F.lit, given)).alias("given"), *((new[c] if c in new else nothing.cast(k)).alias(c) for c, k in (("status", "string"), ("percent_complete", "int"), ("assignee_id", "bigint"), ("description", "string"), ("due_date", "string"))))
    status = t.where(part % 6 == 0).select(key, F.col("assignee_id").alias("actor_id"), role.alias("actor_role"), *row("status", "percent_complete", status=E.pick(["Complete", "Blocked", "In Progress"], part % 3 + part % 2), percent_complete=(part % 101).cast("int")))
    handed = t.where(part % 6 == 1).select(key, (F.col("assignee_id") + part % 4 - 1).alias("actor_id"), F.lit("member").alias("actor_role"), *row("assignee_id", assignee_id=F.col("assignee_id") + part % 2))
    dated = E.projects(s, d).where("project_id % 10 = 0").select(F.concat(F.lit("P"), "project_id").alias("task_id"), F.lit(1).cast("bigint").alias("actor_id"), F.lit("lead").alias("actor_role"), *row("description", "due_date", description=F.lit("changed"), due_date=F.lit(E.AS_OF)))
    gone = s.range(1).select(F.lit("none").alias("task_id"), F.lit(1).cast("bigint").alias("actor_id"), F.lit("lead").alias("actor_role"), *row("status"))
    all_ = reduce(DataFrame.unionByName, [status, handed, dated, gone])
    # one of each task, as a struct: all uses ask for the same columns and share one exchange
    return all_.groupBy("task_id").agg(F.first(F.struct(*all_.columns[1:])).alias("one")).select("task_id", "one.*")


def patched(s, d) -> tuple[DataFrame, DataFrame]:
    return TE.patch_tasks(grouped_tasks(s, d), task_patches(s, d), ["lead", "admin", "vp", "super_admin"], F.date_format(E.now(), "yyyy-MM-dd HH:mm:ss"))


PATCHED = f""", child AS (SELECT project_id || '/' || line_no || '/' || part_id || '/' || assignee_id AS task_id, 'P' || project_id AS parent_task_id, project_id, false AS is_group_parent, assignee_id, part_id, ({ROLE})[part_id % 5 + 1] AS role, status, percent_complete, CAST(due_date AS VARCHAR) AS due_date, strftime(completed_at, '%Y-%m-%d %H:%M:%S') AS completed_at FROM tasks),
v AS (SELECT *, CASE WHEN part_id % 6 = 0 THEN 'written' WHEN part_id % 6 = 1 THEN CASE WHEN part_id % 4 <> 1 THEN 'own only' WHEN part_id % 2 <> 0 THEN 'no handing on' ELSE 'written' END END AS verdict,
  CASE WHEN part_id % 6 = 0 THEN CASE WHEN (['Complete', 'Blocked', 'In Progress'])[part_id % 3 + part_id % 2 + 1] = 'Complete' AND role NOT IN ('lead', 'admin', 'vp', 'super_admin') THEN 'Pending Review' ELSE (['Complete', 'Blocked', 'In Progress'])[part_id % 3 + part_id % 2 + 1] END END AS asked FROM child),
w AS (SELECT *, coalesce(asked, status) AS new_status, CASE WHEN asked IS NOT NULL THEN part_id % 101 ELSE percent_complete END AS new_percent, CASE WHEN asked = 'Complete' AND status <> 'Complete' THEN strftime({NOW}, '%Y-%m-%d %H:%M:%S') WHEN asked <> 'Complete' AND status = 'Complete' THEN NULL ELSE completed_at END AS new_stamp,
  project_id % 10 = 0 AND coalesce(asked, status) <> 'Complete' AND coalesce(asked, status) IS NOT NULL AND parent_task_id IN (SELECT 'P' || project_id FROM projects) AS passed FROM v),
k AS (SELECT parent_task_id, CAST(floor(avg(new_percent) + 0.5) AS INTEGER) AS percent, CASE WHEN bool_and(new_status = 'Complete') THEN 'Complete' WHEN bool_or(new_status = 'Blocked') THEN 'Blocked' WHEN bool_or(new_status IN {ACTIVE}) THEN 'In Progress' ELSE 'Not Started' END AS status FROM w GROUP BY 1 HAVING bool_or(verdict = 'written'))"""


@query(f"""{PATCHED} SELECT task_id, assignee_id, new_status AS status, new_percent AS percent_complete, CASE WHEN passed THEN '1998-06-01' ELSE due_date END AS due_date, CASE WHEN passed THEN 'changed' ELSE 'do' END AS description, new_stamp AS completed_at FROM w
  UNION ALL SELECT 'P' || project_id, owner_id, coalesce(k.status, 'Not Started'), coalesce(percent, 0), CASE WHEN project_id % 10 = 0 THEN '1998-06-01' END, CASE WHEN project_id % 10 = 0 THEN 'changed' ELSE 'group' END, NULL FROM projects LEFT JOIN k ON parent_task_id = 'P' || project_id""")
def m_3_patched_tasks(s, d):
    """All tasks after a batch of updates, with what children and parents take from it."""
    return patched(s, d)[0].select("task_id", "assignee_id", "status", "percent_complete", "due_date", "description", "completed_at")


@query(f"{PATCHED} SELECT task_id, verdict FROM w WHERE verdict IS NOT NULL UNION ALL SELECT 'P' || project_id, 'written' FROM projects WHERE project_id % 10 = 0 UNION ALL SELECT 'none', 'not found'")
def m_3_patch_verdicts(s, d):
    return patched(s, d)[1]


@query("""SELECT event_id, CASE WHEN event_id % 4 = 1 THEN '{"value":' || json_extract_string(props, '$.k') ELSE left(props, length(props) - 1) END || CASE WHEN user_id % 3 = 0 THEN ',"actingAs":"u' || user_id || '"' ELSE '' END || '}' AS merged FROM events""")
def x_26_event_values(s, d):
    """Events' properties as audit values: each fourth a scalar, which is wrapped, each third user acting for another."""
    value = F.when(F.col("event_id") % 4 == 1, F.get_json_object("props", "$.k")).otherwise(F.col("props"))
    e = E.events(s, d).select("event_id", value.alias("x"), F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("u"), "user_id")).alias("u"))
    return e.select("event_id", X.audit_value(F.col("x"), F.col("u")).alias("merged"))


#: The workbook's sheets, each by its query.
SHEETS = {"cover": W.v_18_cover_sheet_rows, "initiatives": W.v_14_initiatives_sheet, "drill_down": views.v_15_drill_down_rows, "completed": W.v_16_completed_sheet_rows, "weekly": W.v_17_weekly_sheet_rows}
SHEET_COLUMNS = {
    "cover": ["label", "value"], "initiatives": ["name", "owner", "status", "current", "target", "attainment", "tactics", "on_track", "on_track_percent", "tasks", "overdue", "average"],
    "drill_down": ["name", "owner", "status", "priority", "due", "completed", "percent", "notes"], "completed": ["completed_on", "tactic", "initiative", "assignee", "role", "description", "priority", "due_date", "vs_due", "project_id"],
    "weekly": ["metric", "developer", "target", *(f"week_{k}" for k in range(1, 7)), "total", "total_target", "share"],
}


def workbook(s, d, ordered: bool = True) -> dict[str, DataFrame]:
    """The five sheets with all rows and columns, as sinks.write_sheets takes them; unless ordered, the drill-down isn't sorted."""
    sheets = SHEETS if ordered else SHEETS | {"drill_down": views.drill_down_lines}
    return {name: of(s, d).select(*SHEET_COLUMNS[name]) for name, of in sheets.items()}


@query(" UNION ALL ".join(f"SELECT '{name}' AS sheet, CAST(to_json({{{', '.join(f'{chr(39)}{c}{chr(39)}: {c}' for c in SHEET_COLUMNS[name])}}}) AS VARCHAR) AS cells FROM ({(W.SQL | views.SQL)[of.__name__]})" for name, of in SHEETS.items()), base=False)
def k_3_workbook_rows(s, d):
    """Every row of the five sheets, in no order."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("sheet"), T.json_text(F.struct(*df.columns)).alias("cells")) for name, df in workbook(s, d, ordered=False).items()])
