"""Rules on literal rows, each beside its SQL. They read no table, so they are tests and no queries."""

import collections
from functools import reduce

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.operators import maintain as M
from cadenza.operators import report as R
from cadenza.plans.catalog import day, tables
from cadenza.plans.oracle import BASE, KPI, ROLE, SRC
from cadenza.plans.views import placed, report
from cadenza.plans.whole import CATALOGUE, ROLE_DEFAULTS
from cadenza.sources import entities as E

SF = "/root/testdata/sf0.001"
RULES = {}


def rule(sql):
    def add(f):
        RULES[f.__name__] = (f, f"WITH {BASE} {sql}")
        return f

    return add


@rule('SELECT * FROM drift')
def j_23_schema_drift(s, d):
    expected = s.createDataFrame([("users", "id", "text"), ("users", "email", "text"), ("tasks", "id", "integer"), ("tasks", "due", "date")], "table_name string, column_name string, type string")
    live = s.createDataFrame([("users", "id", "text"), ("users", "email", "character varying(80)"), ("tasks", "id", "integer"), ("tasks", "extra", "text")], "table_name string, column_name string, type string")
    return M.drift(expected, live)


@rule('SELECT CAST(count(*) AS DOUBLE) AS count FROM camps WHERE false GROUP BY channel')
def rs_6_no_rows(s, d):
    return R.run_report(tables(s, d), R.Spec(["campaigns"], [R.Metric("count")], [], [R.Filter("channel", "in", "Email")]))


@rule('SELECT id, CAST(value AS DOUBLE) AS value FROM (VALUES (0, 12.0), (1, 3.5), (2, -7.0), (3, 0.0), (4, 0.0), (5, 0.0), (6, 0.5), (7, 1000.0), (8, 4.0), (9, 0.0), (10, 2026.0)) v(id, value)')
def x_14_leading_numbers(s, d):
    rows = [(k, v) for k, v in enumerate(["12abc", " 3.5x", "-7", "abc", "", None, ".5", "1e3z", "+4.", "1e999", "2026-05-01"])]
    return s.createDataFrame(rows, "id bigint, x string").select("id", X.leading_number(F.col("x")).alias("value"))


@rule('SELECT id, CASE WHEN regexp_matches(c, \'[",\' || chr(10) || \']\') THEN \'"\' || replace(c, \'"\', \'""\') || \'"\' ELSE c END AS csv, replace(replace(replace(replace(replace(c, \'&\', \'&amp;\'), \'<\', \'&lt;\'), \'>\', \'&gt;\'), \'"\', \'&quot;\'), \'\'\'\', \'&#39;\') AS html FROM (SELECT id, coalesce(x, \'\') AS c FROM (VALUES (0, \'plain\'), (1, \'a,b\'), (2, \'say "x"\'), (3, \'two\' || chr(10) || \'lines\'), (4, \'\'), (5, NULL), (6, \'<a href=\'\'x\'\'>&</a>\')) v(id, x))')
def x_15_escapes(s, d):
    rows = [(k, v) for k, v in enumerate(["plain", "a,b", 'say "x"', "two\nlines", "", None, "<a href='x'>&</a>"])]
    return s.createDataFrame(rows, "id bigint, x string").select("id", X.csv_cell(F.col("x")).alias("csv"), X.html_text(F.col("x")).alias("html"))


@rule('SELECT problem, count(*) AS n FROM drift GROUP BY 1')
def v_30_drift_summary(s, d):
    return j_23_schema_drift(s, d).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@rule(f"SELECT unnest({SRC}) AS source_system, 'connected' AS status")
def s_10_connections(s, d):
    return E.connections(s).select("source_system", "status")


@rule("SELECT * FROM (VALUES ('region', 0, 'r_regionkey', 'int'), ('region', 1, 'r_name', 'string'), ('nation', 0, 'n_nationkey', 'int'), ('nation', 1, 'n_name', 'string'), ('nation', 2, 'n_regionkey', 'int')) v(table_name, position, column_name, type)")
def s_14_catalog_scan(s, d):
    """Columns of the tables, from their schemas; no data is read."""
    found = [(t, i, f.name, f.dataType.simpleString()) for t in ("region", "nation") for i, f in enumerate(E.table(s, d, t).schema)]
    return s.createDataFrame(found, "table_name string, position int, column_name string, type string")


INDEXES = [("users_pk", True, ["id"]), ("entries_key", True, ["metric_id", "user_id", "period_start"]), ("tasks_status", False, ["status", None])]


@rule("SELECT * FROM (VALUES ('users_pk', true, 'id'), ('entries_key', true, 'metric_id,user_id,period_start'), ('tasks_status', false, 'status')) v(index_name, is_unique, columns)")
def j_24_a_32_index_columns(s, d):
    """Index columns by their ordinal, unknown ones left out, put together again in order."""
    ix = s.createDataFrame(INDEXES, "index_name string, is_unique boolean, keys array<string>")
    parts = ix.select("index_name", "is_unique", F.posexplode("keys").alias("ord", "key")).where("key IS NOT NULL")
    by = parts.groupBy("index_name").agg(F.bool_or("is_unique").alias("is_unique"), F.sort_array(F.collect_list(F.struct("ord", "key"))).alias("k"))
    return by.select("index_name", "is_unique", F.concat_ws(",", F.transform("k", lambda x: x["key"])).alias("columns"))


@rule("SELECT channel, CAST(count(*) AS DOUBLE) AS n FROM camps WHERE false GROUP BY 1")
def rs_2_no_list(s, d):
    """in and notIn of what is no list hold for nothing."""
    return report(s, d, ["campaigns"], [R.Metric("count", label="n")], ["channel"], [R.Filter("channel", "notIn", "Email")])


@rule("SELECT * FROM (VALUES ('a', 1), ('A', 2), ('b', 3), ('B', 4), ('e', 5), ('é', 6), ('z', 7)) v(name, place)")
def o_4_locale_names(s, d):
    names = s.createDataFrame([(x,) for x in ("z", "é", "B", "a", "A", "e", "b")], "name string")
    return placed(names, F.collate("name", "UNICODE"))


@rule(f"SELECT role FROM (SELECT unnest({ROLE}) AS role) WHERE role <> 'observer'")
def so_7_all_but_one(s, d):
    return s.range(1).select(F.explode(F.array_except(F.array(*map(F.lit, E.ROLES)), F.array(F.lit("observer")))).alias("role"))


@rule(f"SELECT k, CAST(CAST(date_trunc('week', {KPI}) AS DATE) - CAST(7 * k AS INTEGER) AS VARCHAR) AS prior, CAST(DATE '1998-06-01' + CAST(k AS INTEGER) AS VARCHAR) AS later, '2024-01-22 09:00' AS lock FROM range(6) r(k)")
def x_3_to_x_5_days(s, d):
    k = F.col("id").cast("int")
    return s.range(6).select(F.col("id").alias("k"), F.date_sub(X.monday(E.kpi_now()), k * 7).cast("string").alias("prior"), F.date_add(E.as_of(), k).cast("string").alias("later"), F.date_format(X.lock_time(E.kpi_now()), "yyyy-MM-dd HH:mm").alias("lock"))


LINKS = [("a", "example.org"), ("b", "https://example.org"), ("c", "HTTP://x"), ("d", "2024-01-01"), ("e", "")]


@rule("SELECT * FROM (VALUES ('a', 'https://example.org', false), ('b', 'https://example.org', false), ('c', 'HTTP://x', false), ('d', 'https://2024-01-01', true), ('e', 'https://', false)) v(id, link, is_day)")
def x_22_patterns(s, d):
    return s.createDataFrame(LINKS, "id string, x string").select("id", X.web_link(F.col("x")).alias("link"), F.col("x").rlike(r"^\d{4}-\d{2}-\d{2}$").alias("is_day"))


TYPES = ["serial", "varchar(80)", "int4", "timestamptz", "numeric(14, 2)", "bool", "text"]


@rule("SELECT * FROM (VALUES ('serial', 'integer'), ('varchar(80)', 'character varying(80)'), ('int4', 'integer'), ('timestamptz', 'timestamp with time zone'), ('numeric(14, 2)', 'numeric(14,2)'), ('bool', 'boolean'), ('text', 'text')) v(type, canonical)")
def x_30_type_names(s, d):
    return s.createDataFrame([(x,) for x in TYPES], "type string").select("type", X.canonical_type(F.col("type")).alias("canonical"))


@rule("SELECT '2024-01-22' AS current_week, '2024-01-15' AS last_week, '2024-01-22 09:00' AS locks_at, true AS last_locked")
def v_13_lock_status(s, d):
    now = E.kpi_now()
    last = X.prior_monday(now, 1)
    return s.range(1).select(X.monday(now).cast("string").alias("current_week"), last.cast("string").alias("last_week"), F.date_format(X.lock_time(now), "yyyy-MM-dd HH:mm").alias("locks_at"), X.week_locked(last, now).alias("last_locked"))


MATRIX = [("member", "view"), ("lead", "view"), ("lead", "assign"), ("admin", "view"), ("admin", "assign"), ("admin", "manage")]


@rule(f"SELECT role, coalesce(p, '') AS permissions FROM (SELECT unnest({ROLE}) AS role) LEFT JOIN (VALUES ('member', 'view'), ('lead', 'assign,view'), ('admin', 'assign,manage,view')) v(role, p) USING (role)")
def v_26_r_1_matrix(s, d):
    roles = s.createDataFrame([(r,) for r in E.ROLES], "role string")
    by = s.createDataFrame(MATRIX, "role string, key string").groupBy("role").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return roles.join(by, "role", "left").select("role", F.coalesce(F.concat_ws(",", "keys"), F.lit("")).alias("permissions"))


@rule("SELECT DISTINCT CAST(period_start AS VARCHAR) AS period_start, period_start = DATE '2024-01-08' AS is_new FROM (SELECT DATE '2024-01-01' AS period_start UNION ALL SELECT DATE '2024-01-08')")
def m_7_unlock_week(s, d):
    """An override for a week that has one already is not added again."""
    old = s.createDataFrame([("2024-01-01", False)], "period_start string, is_new boolean")
    asked = s.createDataFrame([("2024-01-01", True), ("2024-01-08", True)], "period_start string, is_new boolean")
    return M.insert_missing(old, asked, ["period_start"])


@rule("SELECT * FROM (VALUES ('view', 'View'), ('assign', 'Assign'), ('old', 'Kept')) v(key, label)")
def m_11_bootstrap(s, d):
    """The catalogue's labels replace old ones; keys it doesn't know stay."""
    old = s.createDataFrame([("view", "Look"), ("old", "Kept")], "key string, label string")
    return M.upsert(old, s.createDataFrame([("view", "View"), ("assign", "Assign")], "key string, label string"), ["key"])


@rule("SELECT '2024-01-22' AS current_week, '2024-01-15' AS prior_week, true AS lock_active, false AS override_active, '2024-01-22 09:00' AS locks_at")
def v_13_lock_status_whole(s, d):
    now = E.kpi_now()
    over = s.createDataFrame([("2024-01-08",)], "p string").select(F.to_date("p").alias("period_start"))
    last = s.range(1).select(X.prior_monday(now, 1).alias("period_start"))
    held = last.join(over.withColumn("override_active", F.lit(True)), "period_start", "left")
    return held.select(X.monday(now).cast("string").alias("current_week"), day("period_start"), X.week_locked(F.col("period_start"), now).alias("lock_active"), F.coalesce("override_active", F.lit(False)).alias("override_active"), F.date_format(X.lock_time(now), "yyyy-MM-dd HH:mm").alias("locks_at")).withColumnRenamed("period_start", "prior_week")


@rule(f"SELECT ({SRC})[2] AS source_system, 'connected' AS status")
def s_10_one_connection(s, d):
    return E.read_filtered(E.connections(s), source_system="hubspot")


@rule("SELECT * FROM (VALUES " + ", ".join(f"('{src}', '{kind}', {k}, '{f}')" for src, both in CATALOGUE.items() for kind, fs in zip(("dimension", "measure"), both, strict=True) for k, f in enumerate(fs)) + ") v(source, kind, position, field)")
def rs_16_catalogue(s, d):
    offered = [(src, kind, k, f) for src, both in CATALOGUE.items() for kind, fs in zip(("dimension", "measure"), both, strict=True) for k, f in enumerate(fs)]
    return s.createDataFrame(offered, "source string, kind string, position int, field string")


MONEY = [(1, 0.0, "$0", "$0"), (2, 950.4, "$950", "$950.4"), (3, 1234.5, "$1,235", "$1.2K"), (4, 999950.0, "$999,950", "$1M"), (5, -2500000.0, "-$2,500,000", "-$2.5M"), (6, 3.2e9, "$3,200,000,000", "$3.2B"), (7, None, "—", "—"), (8, 12.0, "$12", "$12"), (9, 1000.0, "$1,000", "$1K")]


@rule("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, _, a, b in MONEY) + ") v(id, shown, compact)")
def x_17_currency(s, d):
    x = F.col("x")
    return s.createDataFrame([(k, v) for k, v, *_ in MONEY], "id int, x double").select("id", X.currency(x).alias("shown"), X.compact_currency(x).alias("compact"))


@rule("SELECT * FROM (VALUES ('member', 'view'), ('super_admin', 'manage'), ('observer', 'view')) v(role, key)")
def m_11_ensured(s, d):
    """An empty table is seeded with the defaults; what must be there is there once."""
    kind = "role string, key string"
    defaults = s.createDataFrame([("member", "view"), ("observer", "view")], kind)
    return M.ensure_permissions(s.createDataFrame([], kind), defaults, s.createDataFrame([("super_admin", "manage"), ("observer", "view")], kind))


DEFAULTS = [(1, "('member'::text)", "'member'"), (2, "now()", "now()"), (3, "((0))", "0"), (4, "'{}'::character varying(80)[]", "'{}'"), (5, "false", "false"), (6, None, None)]


@rule("SELECT * FROM (VALUES " + ", ".join(f"({k}, {'NULL' if b is None else repr(b) if chr(39) not in b else chr(39) + b.replace(chr(39), chr(39) * 2) + chr(39)})" for k, _, b in DEFAULTS) + ") v(id, literal)")
def x_30_default_literals(s, d):
    return s.createDataFrame([(k, a) for k, a, _ in DEFAULTS], "id int, x string").select("id", X.default_literal(F.col("x")).alias("literal"))


MERGED = [(1, '{"a":1}', None, '{"a":1}'), (2, '{"a":1}', "u1", '{"a":1,"actingAs":"u1"}'), (3, "5", "u1", '{"value":5,"actingAs":"u1"}'), (4, "[1,2]", None, '{"value":[1,2]}'), (5, "{}", "u1", '{"actingAs":"u1"}'), (6, None, None, '{"value":null}')]


@rule("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{b}')" for k, _, _, b in MERGED) + ") v(id, merged)")
def x_26_audit_values(s, d):
    return s.createDataFrame([(k, a, u) for k, a, u, _ in MERGED], "id int, x string, u string").select("id", X.audit_value(F.col("x"), F.col("u")).alias("merged"))


HELD = [("lead", "assign_tasks"), ("lead", "view_reports"), ("lead", "assign_tasks"), ("intern", "view_reports")]


@rule("SELECT * FROM (VALUES " + ", ".join(f"('empty', '{r}', {k}, '{','.join(sorted(keys))}'), ('held', '{r}', {k}, '{'assign_tasks,view_reports' if r == 'lead' else ''}')" for k, (r, keys) in enumerate(ROLE_DEFAULTS.items())) + ") v(table_state, role, position, permissions)")
def r_1_role_permissions(s, d):
    """R-1, V-26: each role's permissions, without held rows and with some; held rows of unknown roles count for none."""
    kind = "role string, key string"
    defaults = s.createDataFrame([(r, k) for r, keys in ROLE_DEFAULTS.items() for k in keys], kind)
    states = {"empty": s.createDataFrame([], kind), "held": s.createDataFrame(HELD, kind)}
    parts = [M.role_permissions(held, defaults, list(ROLE_DEFAULTS)).withColumn("table_state", F.lit(name)) for name, held in states.items()]
    return reduce(DataFrame.unionByName, parts)


def plain(v):
    return v if v is None or isinstance(v, (bool, str)) else round(float(v), 6)


@pytest.mark.parametrize("name", sorted(RULES))
def test_rule_equals_sql(spark, name):
    f, sql = RULES[name]
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    df = f(spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert collections.Counter(tuple(map(plain, r)) for r in df.select(*names).collect()) == collections.Counter(tuple(map(plain, r)) for r in cur.fetchall())
