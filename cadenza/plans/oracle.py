"""DuckDB SQL for the catalog's queries, over the same tables."""

from __future__ import annotations

ROLE = "['member', 'lead', 'admin', 'vp', 'super_admin', 'observer']"
SRC = "['salesforce', 'hubspot']"
STAGES = "['Prospecting', 'Qualification', 'Discovery', 'Proposal', 'Negotiation', 'Closed Won', 'Closed Lost']"
ASOF, NOW, KPI = "DATE '1998-06-01'", "TIMESTAMP '1998-06-01 12:00:00'", "TIMESTAMP '2024-01-24 12:00:00'"
ACTIVE = "('In Progress', 'Waiting on Someone', 'Pending Review')"

BASE = f"""
areas AS (SELECT r_regionkey AS area_id, r_name AS area_name, r_regionkey AS sort_order FROM region),
targets AS (SELECT r_regionkey AS area_id, r_regionkey % 4 * 50 AS target_numeric, r_regionkey * 17 AS current_numeric, r_regionkey * 3 AS updated_by_id FROM region WHERE r_regionkey > 0),
projects AS (SELECT o_orderkey AS project_id, 'P' || (o_orderkey % 7 + 1) || '-' || o_orderkey AS code, o_custkey AS owner_id, n_regionkey AS area_id
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
t0 AS (SELECT *, l_returnflag || l_linestatus AS flags, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS stamp FROM lineitem),
tasks AS (SELECT l_orderkey AS project_id, l_linenumber AS line_no, l_suppkey AS assignee_id, l_partkey AS part_id,
  CASE flags WHEN 'AF' THEN 'Complete' WHEN 'AO' THEN 'Not Started' WHEN 'NF' THEN 'In Progress' WHEN 'NO' THEN 'Waiting on Someone' WHEN 'RF' THEN 'Blocked' WHEN 'RO' THEN 'Pending Review' END AS status,
  (['Critical', 'High', 'Medium', 'Low'])[l_linenumber % 4 + 1] AS priority, CAST(l_shipdate AS DATE) AS due_date, CAST(l_quantity * 2 AS INTEGER) AS percent_complete,
  CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 10 + 1 END AS blocked_by_id, CASE WHEN l_partkey % 4 = 0 THEN l_partkey % 7 + 1 END AS escalated_to_id,
  CASE WHEN l_partkey % 4 = 0 THEN stamp + INTERVAL 5 HOUR END AS escalated_at, CASE WHEN l_partkey % 8 = 0 THEN stamp + INTERVAL 30 HOUR END AS escalation_resolved_at,
  CASE WHEN flags = 'AF' THEN stamp + to_hours(CAST(l_quantity * 3 - 72 AS BIGINT)) END AS completed_at FROM t0),
users AS (SELECT s_suppkey AS user_id, s_name AS user_name, ({ROLE})[s_suppkey % 6 + 1] AS role, s_suppkey % 9 <> 0 AS is_active,
  CASE WHEN s_suppkey % 5 <> 0 THEN 'User' || s_suppkey || '@Example.com' END AS email, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Name ' || s_suppkey END AS display_name,
  CASE WHEN s_suppkey % 4 <> 0 THEN 'First' END AS first_name, CASE WHEN s_suppkey % 8 < 6 THEN 'Last' ELSE '' END AS last_name FROM supplier),
opps AS (SELECT o_orderkey AS id, ({SRC})[o_orderkey % 2 + 1] AS source_system, 'Opportunity ' || o_orderkey AS name, o_custkey AS account_id, 'Owner ' || nullif(o_custkey % 12, 0) AS owner_name,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_totalprice AS DECIMAL(14, 2)) END AS amount, ({STAGES})[o_orderkey % 7 + 1] AS stage_canonical, CAST(o_orderdate AS DATE) AS close_date FROM orders),
camps AS (SELECT p_partkey AS id, ({SRC})[p_partkey % 2 + 1] AS source_system, p_name AS name, (['Email', 'Webinar', 'Referral', 'Paid Social'])[p_partkey % 4 + 1] AS channel, p_type AS type,
  CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE p_size * 10 END AS sends, p_size * 4 AS opens, p_partkey % 30 AS clicks, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_retailprice AS DECIMAL(14, 2)) END AS influenced_pipeline FROM part),
accounts AS (SELECT c_custkey AS id, ({SRC})[c_custkey % 2 + 1] AS source_system, c_name AS name, c_mktsegment AS type FROM customer),
entries AS (SELECT event_type AS metric, user_id, CAST(date_trunc('week', ts) AS DATE) AS period_start, count(*) AS count FROM events GROUP BY 1, 2, 3),
musers AS (SELECT DISTINCT user_id, ({ROLE})[user_id % 6 + 1] AS role FROM events),
metrics AS (SELECT DISTINCT event_type AS metric, length(event_type) AS target, (['developers', 'all', 'others'])[length(event_type) % 3 + 1] AS applies_to FROM events),
weeks AS (SELECT CAST(date_trunc('week', {KPI}) AS DATE) - CAST(7 * k AS INTEGER) AS period_start FROM range(6) w(k)),
filled AS (SELECT m.metric, u.user_id, w.period_start, m.target, coalesce(e.count, 0) AS count FROM metrics m JOIN musers u ON m.applies_to <> 'developers' OR u.role IN ('member', 'lead') CROSS JOIN weeks w
  LEFT JOIN entries e ON e.metric = m.metric AND e.user_id = u.user_id AND e.period_start = w.period_start),
current AS (SELECT * FROM filled WHERE period_start = DATE '2024-01-22'),
r0 AS (SELECT project_id, count(*) AS n, count(*) FILTER (status <> 'Complete' AND due_date < {ASOF}) AS late, count(*) FILTER (status = 'Blocked') AS b, count(*) FILTER (status = 'Complete') AS c,
  count(*) FILTER (status IN {ACTIVE}) AS a, sum(percent_complete) AS s FROM tasks GROUP BY 1),
r1 AS (SELECT p.project_id, p.code, p.owner_id, p.area_id, coalesce(n, 0) AS n, coalesce(late, 0) AS late, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(a, 0) AS a, CAST(coalesce(s, 0) AS BIGINT) AS s FROM projects p LEFT JOIN r0 USING (project_id)),
r2 AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(s / n + 0.5) AS BIGINT) END AS pct,
  CASE WHEN n = 0 THEN 'No Tasks' WHEN b > 0 THEN 'Blocked' WHEN late > 0 THEN 'At Risk' WHEN c = n THEN 'Complete' WHEN a > 0 THEN 'In Progress' ELSE 'Not Started' END AS status FROM r1),
rollup_ AS (SELECT *, CASE WHEN status IN ('Blocked', 'At Risk') THEN 'red' WHEN status IN ('Complete', 'In Progress') THEN 'green' WHEN status = 'Not Started' THEN 'amber' ELSE 'gray' END AS health FROM r2),
work AS (SELECT u.user_id, u.user_name, count(t.status) AS total, count(*) FILTER (t.status <> 'Complete') AS open, count(*) FILTER (t.status <> 'Complete' AND t.due_date < {ASOF}) AS overdue,
  CASE WHEN count(t.status) = 0 THEN 0 ELSE CAST(floor(sum(percent_complete) / count(t.status) + 0.5) AS BIGINT) END AS percent_complete FROM users u LEFT JOIN tasks t ON t.assignee_id = u.user_id GROUP BY 1, 2),
stage AS (SELECT unnest(range(7)) AS position, unnest({STAGES}) AS stage),
audit AS (SELECT metric, user_id, period_start, lag(count) OVER (PARTITION BY metric, user_id ORDER BY period_start) AS old_count, count AS new_count FROM entries),
drift AS (SELECT * FROM (VALUES ('tasks', 'due', 'date', NULL, 'missing'), ('tasks', 'extra', NULL, 'text', 'unexpected'), ('users', 'email', 'text', 'character varying(80)', 'type')) v(table_name, column_name, expected, live, problem))
"""

LINE = "project_id, line_no, assignee_id, part_id, status, CAST(due_date AS VARCHAR) AS due_date"


def share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} <> 0 THEN CAST(floor({part} * 100 / {whole} + 0.5) AS BIGINT) END"


def usd(x: str) -> str:
    return f"CAST(sum(coalesce({x}, 0)) AS DOUBLE)"



BODIES = {
    "s_2_projected_scan": "SELECT user_id, role FROM users",
    "s_3_accounts": "SELECT * FROM accounts WHERE source_system = 'hubspot'",
    "s_5_opportunities": "SELECT id, name, CAST(amount AS DOUBLE) AS amount, CAST(close_date AS VARCHAR) AS close_date FROM opps WHERE source_system = 'salesforce' AND stage_canonical = 'Proposal'",
    "s_6_campaigns": "SELECT id, source_system, channel FROM camps",
    "s_8_point_lookup": "SELECT id, source_system, stage_canonical FROM opps WHERE id = 7 AND source_system = 'hubspot'",
    "s_9_linked_records_exist": f"SELECT DISTINCT source_system, id FROM (SELECT ({SRC})[event_id % 2 + 1] AS source_system, event_id * 7 % 4000 AS id FROM events) WHERE (id, source_system) IN (SELECT id, source_system FROM camps)",
    "s_12_fan_out": "SELECT source_system, count(*) AS n FROM opps GROUP BY 1",
    "s_13_first_match": "SELECT id, source_system FROM opps WHERE id = 8 ORDER BY source_system = 'hubspot' LIMIT 1",
    "f_3_in_list": f"SELECT {LINE} FROM tasks WHERE assignee_id IN (1, 2, 3)",
    "f_6_mine_or_blocking": f"SELECT {LINE} FROM tasks WHERE assignee_id = 5 OR (blocked_by_id = 5 AND status = 'Blocked')",
    "f_7_case_insensitive": "SELECT user_id, email FROM users WHERE lower(email) = 'user7@example.com'",
    "f_9_overdue": f"SELECT {LINE} FROM tasks WHERE status <> 'Complete' AND due_date < {ASOF}",
    "f_10_due_soon": f"SELECT {LINE} FROM tasks WHERE status <> 'Complete' AND due_date BETWEEN {ASOF} AND {ASOF} + 7",
    "f_11_overdue_snapshot": f"SELECT status, count(*) AS n FROM tasks WHERE status <> 'Complete' AND CAST(due_date AS TIMESTAMP) < {NOW} GROUP BY 1",
    "f_12_active_escalation": f"SELECT {LINE} FROM tasks WHERE escalated_at IS NOT NULL AND escalation_resolved_at IS NULL",
    "f_13_escalation_inbox": f"SELECT {LINE} FROM tasks WHERE escalated_to_id = 3 AND escalation_resolved_at IS NULL",
    "f_14_blocked_list": f"SELECT {LINE} FROM tasks WHERE status = 'Blocked' AND (escalated_at IS NULL OR escalation_resolved_at IS NOT NULL)",
    "f_16_completed_30d": f"SELECT {LINE} FROM tasks WHERE status = 'Complete' AND completed_at >= {NOW} - INTERVAL 30 DAY",
    "f_17_applies_breakdown": "SELECT metric, count(*) AS users FROM metrics JOIN musers ON applies_to <> 'developers' OR role IN ('member', 'lead') GROUP BY 1",
    "f_18_applies_this_week": "SELECT metric, count(*) AS users FROM metrics JOIN musers ON applies_to = 'all' OR (applies_to = 'developers' AND role IN ('member', 'lead')) GROUP BY 1",
    "f_19_effective_invitation": f"SELECT CASE WHEN event_id % 3 = 0 AND ts + INTERVAL 7 DAY <= {KPI} THEN 'revoked' ELSE (['pending', 'accepted', 'revoked'])[event_id % 3 + 1] END AS status, count(*) AS n FROM events GROUP BY 1",
    "f_20_audit_filter": "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1",
    "f_24_open_pipeline": f"SELECT stage_canonical, {usd('amount')} AS value FROM opps WHERE stage_canonical NOT IN ('Closed Won', 'Closed Lost') GROUP BY 1",
    "f_27_stale": f"SELECT user_id FROM events GROUP BY 1 HAVING {KPI} + INTERVAL 6 DAY - max(ts) > INTERVAL 24 HOUR",
    "p_1_wide_task": f"""SELECT t.project_id, line_no, part_id, status, code, area_id, a.user_name AS assignee_name, b.user_name AS blocked_by_name, e.user_name AS escalated_to_name,
      coalesce(status <> 'Complete' AND due_date < {ASOF}, false) AS is_overdue, coalesce(status <> 'Complete' AND due_date BETWEEN {ASOF} AND {ASOF} + 7, false) AS is_due_soon,
      escalated_at IS NOT NULL AND escalation_resolved_at IS NULL AS is_escalated, coalesce(blocked_by_id = 5 AND status = 'Blocked', false) AS is_blocking_me
      FROM tasks t LEFT JOIN users a ON assignee_id = a.user_id LEFT JOIN users b ON blocked_by_id = b.user_id LEFT JOIN users e ON escalated_to_id = e.user_id LEFT JOIN projects p ON p.project_id = t.project_id""",
    "j_1_projects_areas": "SELECT p.area_id, area_name, count(*) AS n FROM projects p LEFT JOIN areas a ON p.area_id = a.area_id GROUP BY 1, 2",
    "j_3_j_4_targets": "SELECT t.area_id, area_name, target_numeric, current_numeric, user_name AS updated_by FROM targets t JOIN areas a ON t.area_id = a.area_id LEFT JOIN users ON user_id = updated_by_id",
    "j_8_nested_tasks": "SELECT p.project_id, count(t.line_no) AS n, CAST(min(due_date) AS VARCHAR) AS first_due FROM projects p LEFT JOIN tasks t ON p.project_id = t.project_id GROUP BY 1",
    "j_14_filled_spine": "SELECT metric, user_id, CAST(period_start AS VARCHAR) AS period_start, count FROM filled",
    "j_16_semi_projects": "SELECT status, count(*) AS n FROM tasks WHERE project_id IN (SELECT project_id FROM projects WHERE area_id = 2) GROUP BY 1",
    "j_17_merge_memberships": "SELECT CASE user_id WHEN 3 THEN 4 ELSE user_id END AS user_id, count(DISTINCT project_id) AS groups FROM (SELECT project_id, assignee_id AS user_id FROM tasks) GROUP BY 1",
    "j_18_merge_entries": "SELECT metric, 4 AS user_id, CAST(period_start AS VARCHAR) AS period_start, count FROM entries e WHERE user_id = 4 OR (user_id = 3 AND NOT EXISTS (FROM entries x WHERE x.user_id = 4 AND x.metric = e.metric AND x.period_start = e.period_start))",
    "j_19_audit_names": "SELECT metric, coalesce(user_name, CAST(a.user_id AS VARCHAR)) AS who, CAST(period_start AS VARCHAR) AS period_start, old_count, new_count FROM audit a LEFT JOIN users u ON a.user_id = u.user_id WHERE old_count IS NULL OR old_count <> new_count",
    "j_25_polymorphic_links": "SELECT o.id, event_id, 'opportunity' AS record_type, name FROM events JOIN opps o ON o.id = event_id % 3000 WHERE event_id % 2 = 0 UNION ALL SELECT c.id, event_id, 'campaign', name FROM events JOIN camps c ON c.id = event_id % 3000 WHERE event_id % 2 = 1",
    "j_26_recent_events": "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 10",
    "a_1_group_counts": "SELECT p.project_id, count(t.line_no) AS members FROM projects p LEFT JOIN tasks t ON p.project_id = t.project_id GROUP BY 1",
    "a_2_next_order": "SELECT coalesce(max(sort_order), 0) + 1 AS next_order FROM areas",
    "a_3_task_breakdown": "SELECT " + ", ".join(f"count(*) FILTER (status = '{v}') AS {v.lower().replace(' ', '_')}" for v in ("Not Started", "In Progress", "Waiting on Someone", "Blocked", "Pending Review", "Complete")) + ", " + ", ".join(f"count(*) FILTER (priority = '{v}') AS {v.lower()}" for v in ("Critical", "High", "Medium", "Low")) + " FROM tasks",
    "a_4_project_rollup": "SELECT project_id, n AS task_count, late AS overdue_count, b AS blocked_count, c AS complete_count, pct AS percent_complete, status, health FROM rollup_",
    "a_7_portfolio": "SELECT count(*) FILTER (n > 0) AS active_projects, " + ", ".join(f"count(*) FILTER (status = '{v}') AS {v.lower().replace(' ', '_')}" for v in ("Not Started", "In Progress", "At Risk", "Blocked", "Complete")) + ", CAST(sum(n) AS BIGINT) AS total_tasks, CAST(sum(late) AS BIGINT) AS overdue_tasks, CAST(sum(b) AS BIGINT) AS blocked_tasks, coalesce(CAST(floor(avg(pct) FILTER (n > 0) + 0.5) AS BIGINT), 0) AS avg_completion FROM rollup_",
    "a_8_area_rollup": "SELECT a.area_id, area_name, count(project_id) AS project_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS task_count, CASE WHEN coalesce(sum(n), 0) = 0 THEN 0 ELSE CAST(floor(sum(s) / sum(n) + 0.5) AS BIGINT) END AS percent_complete, coalesce(bool_or(late > 0), false) AS has_overdue FROM areas a LEFT JOIN rollup_ r ON a.area_id = r.area_id GROUP BY 1, 2",
    "a_9_workload": "SELECT * FROM work",
    "a_10_cover": "SELECT count(*) AS projects, count(*) FILTER (health = 'green') AS on_track, CAST(sum(late) AS BIGINT) AS overdue_tasks, coalesce(CAST(floor(avg(pct) + 0.5) AS BIGINT), 0) AS avg_completion FROM rollup_",
    "a_11_initiatives": f"""SELECT area_id, area_name, tactics, on_track, coalesce({share("on_track", "tactics")}, 0) AS on_track_percent, tasks, overdue, percent_complete,
      CASE WHEN tactics = 0 THEN 'No Tasks' WHEN complete = tactics THEN 'Complete' WHEN red > 0 THEN 'Blocked' WHEN amber > 0 THEN 'At Risk' ELSE 'On Track' END AS status, CASE WHEN target_numeric > 0 THEN {share("current_numeric", "target_numeric")} END AS attainment
      FROM (SELECT a.area_id, area_name, target_numeric, current_numeric, count(project_id) AS tactics, count(*) FILTER (health = 'green') AS on_track, count(*) FILTER (health = 'red') AS red, count(*) FILTER (health = 'amber') AS amber,
        count(*) FILTER (status = 'Complete') AS complete, CAST(coalesce(sum(n), 0) AS BIGINT) AS tasks, CAST(coalesce(sum(late), 0) AS BIGINT) AS overdue, coalesce(CAST(floor(avg(pct) + 0.5) AS BIGINT), 0) AS percent_complete
        FROM areas a LEFT JOIN rollup_ r ON a.area_id = r.area_id LEFT JOIN targets t ON a.area_id = t.area_id GROUP BY 1, 2, 3, 4)""",
    "a_12_common_owner": "SELECT area_id, owner_id, count(*) AS n FROM projects GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY area_id ORDER BY count(*) DESC, owner_id) = 1",
    "a_15_snapshot": f"""SELECT area_name, count(DISTINCT p.project_id) AS projects, count(t.line_no) AS tasks, count(*) FILTER (status = 'Complete') AS complete, count(*) FILTER (status <> 'Complete' AND CAST(due_date AS TIMESTAMP) < {NOW}) AS overdue,
      CASE WHEN count(t.line_no) = 0 THEN 0 ELSE CAST(floor(sum(percent_complete) / count(t.line_no) + 0.5) AS BIGINT) END AS percent_complete FROM areas a LEFT JOIN projects p ON a.area_id = p.area_id LEFT JOIN tasks t ON t.project_id = p.project_id GROUP BY 1""",
    "a_17_parent_rollup": f"SELECT project_id AS parent_id, CAST(floor(avg(percent_complete) + 0.5) AS BIGINT) AS percent_complete, CASE WHEN bool_and(status = 'Complete') THEN 'Complete' WHEN bool_or(status = 'Blocked') THEN 'Blocked' WHEN bool_or(status IN {ACTIVE}) THEN 'In Progress' ELSE 'Not Started' END AS status FROM tasks GROUP BY 1",
    "a_18_pipeline": f"SELECT position, stage, {usd('amount')} AS value, count(id) AS n FROM stage LEFT JOIN opps ON stage = stage_canonical GROUP BY 1, 2",
    "a_19_pipeline_totals": "SELECT CAST(sum(amount) AS DOUBLE) AS total_value, CAST(sum(amount) FILTER (stage_canonical NOT IN ('Closed Won', 'Closed Lost')) AS DOUBLE) AS open_value, count(*) AS total_count FROM opps",
    "a_20_marketing": f"SELECT CAST(sum(sends) AS BIGINT) AS sends, CAST(sum(opens) AS BIGINT) AS opens, CAST(sum(clicks) AS BIGINT) AS clicks, {usd('influenced_pipeline')} AS influenced, {share('sum(opens)', 'sum(sends)')} AS open_rate, {share('sum(clicks)', 'sum(sends)')} AS click_rate FROM camps",
    "a_21_campaign_rates": f"SELECT id, {share('opens', 'sends')} AS open_rate, {share('clicks', 'sends')} AS click_rate FROM camps",
    "a_22_kpi_breakdown": "SELECT metric, CAST(sum(count) AS BIGINT) AS total_actual, CAST(sum(target) AS BIGINT) AS total_target FROM current GROUP BY 1",
    "a_23_kpi_team": f"SELECT metric, {share('sum(count)', 'sum(target)')} AS target_percent, count(*) FILTER (count >= target) AS on_target, {share('count(*) FILTER (count >= target)', 'count(*)')} AS on_target_percent FROM current GROUP BY 1",
    "a_24_weekly_totals": f"SELECT metric, user_id, CAST(sum(count) AS BIGINT) AS total, {share('sum(count)', 'sum(target)')} AS percent FROM filled GROUP BY GROUPING SETS ((metric, user_id), (metric))",
    "a_26_people_totals": "SELECT CAST(sum(open) AS BIGINT) AS open, CAST(sum(overdue) AS BIGINT) AS overdue, count(*) FILTER (overdue > 0) AS people_overdue FROM work",
    "a_29_status_share": "SELECT s.status, count(t.status) AS n, CAST(floor(count(t.status) * 100 / greatest(sum(count(t.status)) OVER (), 1) + 0.5) AS BIGINT) AS share FROM (SELECT unnest(['Not Started', 'In Progress', 'Waiting on Someone', 'Blocked', 'Pending Review', 'Complete']) AS status) s LEFT JOIN tasks t ON s.status = t.status GROUP BY 1",
    "a_30_latest_sync": "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events",
    "a_31_moved_counts": "SELECT 'assignee_id' AS column_name, count(*) AS moved FROM tasks WHERE assignee_id = 3 HAVING count(*) > 0 UNION ALL SELECT 'blocked_by_id', count(*) FROM tasks WHERE blocked_by_id = 3 HAVING count(*) > 0 UNION ALL SELECT 'escalated_to_id', count(*) FROM tasks WHERE escalated_to_id = 3 HAVING count(*) > 0",
    "a_33_distinct": "SELECT DISTINCT type FROM accounts",
    "a_34_task_report": "SELECT coalesce(CAST(blocked_by_id AS VARCHAR), '—') AS dim, count(*) AS n, floor(avg(percent_complete) * 100 + 0.5) / 100 AS avg_percent FROM tasks GROUP BY 1",
    "rs_17_pipeline_by_stage": f"SELECT stage_canonical, {usd('amount')} AS value FROM opps GROUP BY 1",
    "rs_17_pipeline_by_source": f"SELECT source_system, {usd('amount')} AS value FROM opps GROUP BY 1",
    "rs_17_influenced_pipeline": f"SELECT channel, {usd('influenced_pipeline')} AS influenced FROM camps GROUP BY 1",
    "rs_17_open_by_owner": "SELECT owner_name, CAST(count(*) AS DOUBLE) AS n FROM opps WHERE stage_canonical NOT IN ('Closed Won', 'Closed Lost') GROUP BY 1",
    "rs_1_two_sources": f"SELECT 'opportunities' AS source, source_system, CAST(count(*) AS DOUBLE) AS n, {usd('amount')} AS amount, CAST(0 AS DOUBLE) AS sends FROM opps GROUP BY 2 UNION ALL SELECT 'campaigns', source_system, CAST(2 * count(*) AS DOUBLE), 0, CAST(2 * sum(sends) AS DOUBLE) FROM camps GROUP BY 2",
    "rs_2_strict_filters": "SELECT owner_name, CAST(count(*) AS DOUBLE) AS n FROM opps WHERE owner_name IS NULL OR owner_name NOT IN ('Owner 3', 'Owner 4', 'Owner 5') GROUP BY 1",
    "rs_2_order_filters": f"SELECT stage_canonical, {usd('amount')} / count(*) AS mean, CAST(count(*) AS DOUBLE) AS n FROM opps WHERE coalesce(amount, 0) < 200000 AND year(close_date) >= 1997 GROUP BY 1",
    "rs_6_no_dimensions": "SELECT CAST(sum(clicks) AS DOUBLE) AS sum_clicks_0 FROM camps",
    "o_5_natural_order": "SELECT code, 'P' || lpad(CAST(project_id % 7 + 1 AS VARCHAR), 20, '0') || '-' || lpad(CAST(project_id AS VARCHAR), 20, '0') AS natural_key FROM projects",
    "o_11_clamped_limit": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "o_12_page": "SELECT id, source_system FROM opps ORDER BY source_system = 'hubspot', id LIMIT 25 OFFSET 50",
    "o_12_page_totals": "SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 25) AS BIGINT)) AS pages FROM opps",
    "so_5_difference": "SELECT id, 'tasks' AS side FROM (SELECT assignee_id AS id FROM tasks EXCEPT SELECT user_id FROM users WHERE is_active) UNION ALL SELECT id, 'users' FROM (SELECT user_id AS id FROM users WHERE is_active EXCEPT SELECT assignee_id FROM tasks)",
    "so_8_all_found": "SELECT count(*) AS found, count(*) = 4 AS valid FROM users WHERE user_id IN (1, 2, 99999999)",
    "x_1_display_names": "SELECT user_id, CASE WHEN length(display_name) > 0 THEN display_name WHEN length(concat_ws(' ', nullif(first_name, ''), nullif(last_name, ''))) > 0 THEN concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')) WHEN length(email) > 0 THEN split_part(email, '@', 1) ELSE left('user-000' || user_id, 8) END AS shown FROM users",
    "x_2_mondays": "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS monday, count(*) AS n FROM events GROUP BY 1",
    "x_6_week_locks": "SELECT DISTINCT CAST(period_start AS VARCHAR) AS period_start, period_start < DATE '2024-01-22' AS locked, period_start >= DATE '2024-01-22' OR period_start = DATE '2024-01-08' AS editable FROM entries",
    "x_10_days_vs_due": "SELECT CASE WHEN k <= 0 THEN CAST(-k AS VARCHAR) || ' early' ELSE CAST(k AS VARCHAR) || ' late' END AS days, count(*) AS n FROM (SELECT CAST(floor((epoch_us(completed_at) - epoch_us(CAST(due_date AS TIMESTAMP))) / 86400e6 + 0.5) AS BIGINT) AS k FROM tasks WHERE completed_at IS NOT NULL) GROUP BY 1",
    "x_16_texts": """SELECT id, CASE WHEN id % 2 = 0 THEN 'Blocker: ' || channel || ' • ' ELSE '' END || 'Next: ' || type AS notes, CASE WHEN length(name) > 18 THEN left(name, 18) || '…' ELSE name END AS label,
      'c-' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, upper(CASE WHEN contains(trim(type), ' ') THEN left(trim(type), 1) || left(regexp_extract(trim(type), '[^ ]+$'), 1) ELSE left(trim(type), 2) END) AS initials FROM camps""",
    "x_20_due_colours": f"SELECT CASE WHEN due_date < {ASOF} THEN 'destructive' WHEN due_date <= {ASOF} + 7 THEN 'warning' ELSE 'muted' END AS colour, count(*) AS n FROM tasks GROUP BY 1",
    "x_29_shortfall": f"SELECT metric, user_id, greatest(0, target - count) AS shortfall, least(100, {share('count', 'target')}) AS percent FROM current",
    "v_2_needs_attention": f"SELECT t.project_id, line_no, part_id, assignee_id, coalesce(code, '') AS code, CASE WHEN status <> 'Complete' AND due_date < {ASOF} THEN 'Overdue' ELSE 'Blocked' END AS reason, CAST(due_date AS VARCHAR) AS due_date FROM tasks t LEFT JOIN projects p ON t.project_id = p.project_id WHERE status = 'Blocked' OR (status <> 'Complete' AND due_date < {ASOF})",
    "v_9_kpi_sparkline": "SELECT metric, user_id, string_agg(CAST(count AS VARCHAR), ',' ORDER BY period_start) AS series, arg_max(count, period_start) AS current FROM filled GROUP BY 1, 2",
    "v_15_drill_down": "SELECT 0 AS level, count(*) AS n, min(area_name) AS first_label FROM areas UNION ALL SELECT 1, count(*), min(code) FROM projects WHERE area_id IS NOT NULL UNION ALL SELECT 2, count(*), min(project_id || '/' || line_no) FROM tasks",
    "v_17_weekly_sheet": "SELECT metric, user_id, " + ", ".join(f"CAST(sum(count) FILTER (period_start = DATE '2024-01-22' - {7 * k}) AS BIGINT) AS week_{k}" for k in range(6)) + " FROM filled GROUP BY 1, 2",
    "k_7_conditional_update": f"SELECT CASE WHEN status = 'Blocked' AND due_date < {ASOF} THEN 'Pending Review' ELSE status END AS status, count(*) AS n FROM tasks GROUP BY 1",
    "k_9_cascade": "SELECT priority, count(*) AS n FROM tasks WHERE project_id NOT IN (SELECT project_id FROM projects WHERE area_id = 1) GROUP BY 1",
    "k_10_upsert": "SELECT metric, user_id, CAST(period_start AS VARCHAR) AS period_start, count + CASE WHEN user_id % 10 = 0 THEN 100 ELSE 0 END AS count FROM entries UNION ALL SELECT metric, user_id + 100000, CAST(period_start AS VARCHAR), count FROM entries WHERE user_id % 10 = 1",
    "k_11_insert_missing": "SELECT id, CASE WHEN id % 2 = 0 THEN type ELSE upper(name) END AS type FROM accounts",
    "k_12_replace_set": "SELECT user_id % 5 AS group_id, user_id FROM users WHERE user_id % 5 <> 2 UNION ALL SELECT 2, unnest([1, 9])",
    "m_1_merge_users": "SELECT CASE assignee_id WHEN 3 THEN 4 ELSE assignee_id END AS assignee_id, count(*) AS n, count(*) FILTER (blocked_by_id IN (3, 4)) AS blocked_by_survivor FROM tasks GROUP BY 1",
    "m_2_bulk_assign": "SELECT user_id, unnest(['a', 'b']) AS url FROM users WHERE is_active",
    "m_3_gate_completion": "SELECT CASE status WHEN 'In Progress' THEN 'Pending Review' ELSE status END AS status, count(*) AS n, count(*) FILTER (status = 'Complete') AS stamped FROM tasks GROUP BY 1",
    "m_4_escalation_target": "SELECT user_id, role FROM users WHERE is_active AND role IN ('admin', 'vp') AND user_id <> 2 ORDER BY role = 'vp', user_id <> 5, user_id LIMIT 1",
    "m_4_resolve": "SELECT CASE WHEN escalated_to_id = 3 THEN 7 ELSE assignee_id END AS assignee_id, CASE WHEN escalated_to_id = 3 THEN 'In Progress' ELSE status END AS status, count(*) AS n FROM tasks GROUP BY 1, 2",
    "m_6_kpi_audit": "SELECT metric, user_id, CAST(period_start AS VARCHAR) AS period_start, old_count, new_count FROM audit WHERE old_count IS NULL OR old_count <> new_count",
    "r_2_viewer_tasks": "SELECT 'member' AS role, 6 AS viewer, status, count(*) AS n FROM tasks WHERE assignee_id = 6 OR blocked_by_id = 6 GROUP BY 3 UNION ALL SELECT 'admin', 2, status, count(*) FROM tasks GROUP BY 3",
    "st_1_weekly_windows": "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}

SQL = {name: f"WITH {BASE} {body}" for name, body in BODIES.items()}
