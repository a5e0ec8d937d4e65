"""Scalar rules, lookups and defaults over whole tables, each beside its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import maintain as M
from ..sources import entities as E
from . import whole as W
from .oracle import BASE, SRC

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(sql: str, base: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {BASE} {sql}" if base else sql
        return f

    return add


def text(at: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(at, form)


# --- connections, defaults, permissions ------------------------------------------------------


def synced_connections(s, d) -> DataFrame:
    """A connection for each source of events, with its newest event as the last sync."""
    return E.email_activity(s, d).groupBy("source_system").agg(F.max("sent_at").alias("last_sync_at"), F.count(F.lit(1)).alias("records")).withColumn("status", F.lit("connected"))


CONNECTED = f"SELECT ({SRC})[event_id % 2 + 1] AS source_system, 'connected' AS status, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_sync_at, count(*) AS records FROM events GROUP BY event_id % 2"


@query(CONNECTED, base=False)
def s_10_synced_connections(s, d):
    return synced_connections(s, d).withColumn("last_sync_at", text(F.col("last_sync_at")))


@query(f"SELECT * FROM ({CONNECTED}) WHERE source_system = 'hubspot'", base=False)
def s_10_synced_connection(s, d):
    """One source's connection."""
    return E.read_filtered(synced_connections(s, d), source_system="hubspot").withColumn("last_sync_at", text(F.col("last_sync_at")))


@query("SELECT 'vp' AS asked, role, count(*) AS n FROM users WHERE role = 'vp' GROUP BY 2 UNION ALL SELECT 'ghost', unnest(['member', 'admin']), 0")
def s_15_rows_or_default(s, d):
    """The users of a role, or the defaults where there are none; which it is is found within the plan."""
    users, defaults = E.users(s, d).select("role"), s.createDataFrame([("member",), ("admin",)], "role string")

    def found(role: str) -> DataFrame:
        held = M.rows_or_default(users.where(F.col("role") == role).groupBy("role").agg(F.count(F.lit(1)).alias("n")), defaults.withColumn("n", F.lit(0).cast("bigint")))
        return held.select(F.lit(role).alias("asked"), "role", "n")

    return found("vp").unionByName(found("ghost"))


HELD = "(SELECT DISTINCT role, 'key' || user_id % 4 AS key FROM users WHERE role <> 'observer' UNION ALL SELECT 'intern', 'key9')"


def held_permissions(s, d) -> DataFrame:
    u = E.users(s, d).where("role <> 'observer'")
    return u.select("role", F.concat(F.lit("key"), F.col("user_id") % 4).alias("key")).unionByName(s.createDataFrame([("intern", "key9")], "role string, key string"))


def default_permissions(s) -> DataFrame:
    return s.createDataFrame([(r, k) for r, keys in W.ROLE_DEFAULTS.items() for k in keys], "role string, key string")


@query(f"SELECT user_id, u.role, coalesce((SELECT string_agg(key, ',' ORDER BY key) FROM (SELECT DISTINCT role, key FROM {HELD}) h WHERE h.role = u.role), '') AS permissions FROM users u")
def r_1_user_permissions(s, d):
    """Each user's permissions by role: the held rows, of which there are some; a role without any has none."""
    by = M.role_permissions(held_permissions(s, d), default_permissions(s), list(W.ROLE_DEFAULTS)).select("role", "permissions")
    return E.users(s, d).select("user_id", "role").join(by, "role", "left")


DEFAULTS = " UNION ALL ".join(f"SELECT '{r}' AS role, '{','.join(sorted(keys))}' AS permissions" for r, keys in W.ROLE_DEFAULTS.items())


@query(f"SELECT role, permissions, count(user_id) AS users FROM ({DEFAULTS}) LEFT JOIN users USING (role) GROUP BY 1, 2")
def v_26_default_matrix(s, d):
    """The matrix where no rows are held (here: of users without a role), with how many users have each role."""
    none = E.users(s, d).where("role IS NULL").select("role", F.lit("x").alias("key"))
    by = M.role_permissions(none, default_permissions(s), list(W.ROLE_DEFAULTS)).select("role", "permissions")
    return by.join(E.users(s, d).groupBy("role").agg(F.count(F.lit(1)).alias("users")), "role", "left").select("role", "permissions", F.coalesce("users", F.lit(0)).alias("users"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) FILTER (event_type <> 'error') AS others FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def so_7_types_but_one(s, d):
    """Each user's kinds of events, all but errors."""
    by = E.events(s, d).groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("types"))
    left = F.array_except("types", F.array(F.lit("error")))
    return by.select("user_id", F.when(F.size(left) > 0, F.concat_ws(",", left)).alias("others"))


@query("SELECT DISTINCT p_brand AS key, 'Label of ' || p_brand AS label FROM part WHERE p_size > 25 UNION ALL SELECT DISTINCT p_brand, 'Old' FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 25)", base=False)
def m_11_catalogue(s, d):
    """A catalogue of brands over an older one: its labels replace the old ones, keys it lacks stay."""
    brands = E.table(s, d, "part").select(F.col("p_brand").alias("key"), "p_size")
    old = brands.select("key").distinct().withColumn("label", F.lit("Old"))
    new = brands.where("p_size > 25").select("key").distinct().withColumn("label", F.concat(F.lit("Label of "), "key"))
    return M.upsert(old, new, ["key"])


@query(f"SELECT role, key FROM (SELECT DISTINCT role, key FROM {HELD}) UNION ALL SELECT 'super_admin', 'manage' UNION ALL SELECT 'observer', 'view_reports'")
def m_11_ensured_rows(s, d):
    """Held rows stay, no defaults are seeded, and the two roles' rows that must be there are added."""
    always = s.createDataFrame([("super_admin", "manage"), ("observer", "view_reports")], "role string, key string")
    return M.ensure_permissions(held_permissions(s, d).distinct(), default_permissions(s), always)


@query("SELECT CAST(w AS VARCHAR) AS period_start, dayofyear(w) % 2 = 1 AS is_new FROM (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS w FROM events)", base=False)
def m_7_unlocked_weeks(s, d):
    """Overrides for all weeks of events; those that have one already aren't added again."""
    weeks = E.events(s, d).select(X.monday("ts").alias("w")).distinct()
    old = weeks.where(F.dayofyear("w") % 2 == 0).select(F.col("w").cast("string").alias("period_start"), F.lit(False).alias("is_new"))
    return M.insert_missing(old, weeks.select(F.col("w").cast("string").alias("period_start"), F.lit(True).alias("is_new")), ["period_start"])


# --- indexes and offered fields ------------------------------------------------------------------


@query("SELECT r_name AS index_name, bool_or(n_nationkey % 2 = 0) AS is_unique, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS columns FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1", base=False)
def j_24_a_32_nations_in_order(s, d):
    """Keys taken apart with their places, joined to their names, and put together again in order: each region's nations."""
    n = E.table(s, d, "nation")
    keys = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list("n_nationkey"), asc=False).alias("keys"))
    parts = E.table(s, d, "region").join(keys, "r_regionkey").select(F.col("r_name").alias("index_name"), F.posexplode("keys").alias("ord", "n_nationkey"))
    named = parts.join(n.select("n_nationkey", "n_name"), "n_nationkey", "left").where("n_name IS NOT NULL")
    by = named.groupBy("index_name").agg(F.bool_or(F.col("n_nationkey") % 2 == 0).alias("is_unique"), F.sort_array(F.collect_list(F.struct("ord", "n_name"))).alias("k"))
    return by.select("index_name", "is_unique", F.concat_ws(",", F.transform("k", lambda x: x["n_name"])).alias("columns"))


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


OFFERED = {src: [(kind, snake(f)) for kind, fs in zip(("dimension", "measure"), both, strict=True) for f in fs] for src, both in W.CATALOGUE.items()}
HAS = {"opportunities": ("opps", ["stage_canonical", "source_system", "owner_name", "amount"]), "campaigns": ("camps", ["channel", "type", "source_system", "sends", "opens", "clicks", "influenced_pipeline"]), "accounts": ("accounts", ["type", "source_system"]), "people": ("accounts", ["source_system"]), "email_activity": ("events", ["source_system"]), "tasks": ("tasks", ["status", "priority", "percent_complete"])}


@query(" UNION ALL ".join(f"SELECT '{src}' AS source, '{kind}' AS kind, '{f}' AS field, count({f if HAS[src][0] != 'events' else '*'}) AS filled FROM {HAS[src][0]}" for src, offered in OFFERED.items() for kind, f in offered if f in HAS[src][1]))
def rs_16_offered_fields(s, d):
    """Of the fields that a report may name, those that each source has, with how many rows fill them: one pass over each source."""
    tables = {"opportunities": E.opportunities, "campaigns": E.campaigns, "accounts": E.accounts, "people": E.people, "email_activity": E.email_activity, "tasks": E.tasks}
    parts = []
    for src, of in tables.items():
        df = of(s, d)
        known = [(kind, f) for kind, f in OFFERED[src] if f in df.columns]
        one = df.agg(*(F.count(f).alias(f) for _, f in known))
        pairs = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(f).alias("field"), F.col(f).alias("filled")) for kind, f in known))
        parts.append(one.select(F.lit(src).alias("source"), F.explode(pairs).alias("x")).select("source", "x.*"))
    return reduce(DataFrame.unionByName, parts)


# --- dates -----------------------------------------------------------------------------------------


@query("SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, k, CAST(CAST(date_trunc('week', ts) AS DATE) - CAST(7 * k AS INTEGER) AS VARCHAR) AS prior, count(*) AS n FROM events, range(6) r(k) GROUP BY 1, 2, 3", base=False)
def x_3_prior_mondays(s, d):
    """Events by week, each with the five Mondays before."""
    weeks = E.events(s, d).groupBy(F.date_trunc("week", "ts").cast("timestamp").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    parts = [weeks.select(X.monday("at").cast("string").alias("week"), F.lit(k).cast("bigint").alias("k"), X.prior_monday(F.col("at"), k).cast("string").alias("prior"), "n") for k in range(6)]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS VARCHAR) AS later FROM orders", base=False)
def x_4_days_after(s, d):
    o = E.table(s, d, "orders")
    return o.select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 30).cast("int")).cast("string").alias("later"))


@query("SELECT strftime(date_trunc('week', ts) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS locks_at, ts >= date_trunc('week', ts) + INTERVAL 9 HOUR AS locked, count(*) AS n FROM events GROUP BY 1, 2", base=False)
def x_5_lock_times(s, d):
    """Events before and after the lock of their week."""
    at = F.col("ts").cast("timestamp")
    return E.events(s, d).groupBy(text(X.lock_time(at), "yyyy-MM-dd HH:mm").alias("locks_at"), (at >= X.lock_time(at)).alias("locked")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS current_week, CAST(CAST(date_trunc('week', ts) AS DATE) - 7 AS VARCHAR) AS prior_week, ts >= date_trunc('week', ts) + INTERVAL 9 HOUR AS lock_active,
  CAST(date_trunc('week', ts) AS DATE) - 7 = DATE '2024-01-08' AS override_active, strftime(date_trunc('week', ts) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS locks_at, count(*) AS n FROM events GROUP BY ALL""", base=False)
def v_13_lock_statuses(s, d):
    """The five scalars as of each event's time, with how many events have them."""
    at = F.col("ts").cast("timestamp")
    over = s.createDataFrame([("2024-01-08",)], "p string").select(F.to_date("p").alias("prior"), F.lit(True).alias("override"))
    e = E.events(s, d).select(X.monday(at).alias("week"), X.prior_monday(at, 1).alias("prior"), X.week_locked(X.prior_monday(at, 1), at).alias("lock_active"), text(X.lock_time(at), "yyyy-MM-dd HH:mm").alias("locks_at"))
    by = e.groupBy("week", "prior", "lock_active", "locks_at").agg(F.count(F.lit(1)).alias("n")).join(over, "prior", "left")
    return by.select(F.col("week").cast("string").alias("current_week"), F.col("prior").cast("string").alias("prior_week"), "lock_active", F.coalesce("override", F.lit(False)).alias("override_active"), "locks_at", "n")


# --- texts -----------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CAST(CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN p_retailprice WHEN 2 THEN -p_size WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN p_size / 100 WHEN 6 THEN p_size * 1000 WHEN 7 THEN 0 END AS DOUBLE) AS value FROM part""", base=False)
def x_14_part_numbers(s, d):
    """The numbers that texts made of the parts begin with."""
    size, price = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    forms = [F.concat(size, F.lit("abc")), F.concat(F.lit(" \t"), price, F.lit("x1")), F.concat(F.lit("-"), size, F.lit("-3")), F.col("p_name"), F.lit(None).cast("string"), F.concat(F.lit("."), F.lpad(size, 2, "0"), F.lit(".5")), F.concat(size, F.lit("e3z")), F.lit("1e999")]
    k, said = F.col("p_partkey") % 8, F.lit(None).cast("string")
    for i, f in enumerate(forms):
        said = F.when(k == i, f).otherwise(said)
    return E.table(s, d, "part").select("p_partkey", X.leading_number(said).alias("value"))


@query('''SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '"<b>' || c_name || '</b>, ""' || c_mktsegment || ' & co"""' ELSE c_name END AS csv,
  CASE WHEN c_custkey % 2 = 0 THEN '&lt;b&gt;' || c_name || '&lt;/b&gt;, &quot;' || c_mktsegment || ' &amp; co&quot;' ELSE c_name END AS html FROM customer''', base=False)
def x_15_customer_cells(s, d):
    said = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("<b>"), "c_name", F.lit('</b>, "'), "c_mktsegment", F.lit(' & co"'))).otherwise(F.col("c_name"))
    return E.table(s, d, "customer").select("c_custkey", X.csv_cell(said).alias("csv"), X.html_text(said).alias("html"))


# tenths of thousands and of millions, from whole cents
CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
TENTHS = lambda unit: f"({CENTS} + {unit * 5}) // {unit * 10}"
SHORT = lambda unit, name: f"'$' || ({TENTHS(unit)}) // 10 || CASE WHEN ({TENTHS(unit)}) % 10 <> 0 THEN '.' || ({TENTHS(unit)}) % 10 ELSE '' END || '{name}'"


@query(f"SELECT o_orderkey, '$' || format('{{:,}}', ({CENTS} + 50) // 100) AS shown, CASE WHEN {CENTS} >= 99995000 THEN {SHORT(1_000_000, 'M')} WHEN {CENTS} >= 99995 THEN {SHORT(1_000, 'K')} ELSE {SHORT(1, '')} END AS compact FROM orders", base=False)
def x_17_order_totals(s, d):
    x = F.col("o_totalprice")
    return E.table(s, d, "orders").select("o_orderkey", X.currency(x).alias("shown"), X.compact_currency(x).alias("compact"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://' || regexp_replace(url, '^https?://', '') ELSE url END AS link, false AS url_is_day, true AS day_is_day FROM pages", base=False)
def x_22_page_links(s, d):
    """Links of pages, a third of which have lost their scheme; a url is no day, and a day is one."""
    said = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    is_day = lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}$")
    date = F.date_add(E.as_of(), (F.col("page_id") % 1000).cast("int")).cast("string")
    return E.table(s, d, "pages").select("page_id", X.web_link(said).alias("link"), is_day(said).alias("url_is_day"), is_day(date).alias("day_is_day"))


DUCK = {"INTEGER": "integer", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "BIGINT": "bigint", "DOUBLE": "double"}


@query("SELECT table_name, column_name, CASE column_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DUCK.items()) + " END AS canonical FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, column_type FROM (DESCRIBE {t})" for t in W.DECLARED) + ")", base=False)
def x_30_column_types(s, d):
    """One spelling for the type of each column of the star schema, as its files have it."""
    return W.scanned(s, d).select("table_name", "column_name", X.canonical_type(F.col("type")).alias("canonical"))
