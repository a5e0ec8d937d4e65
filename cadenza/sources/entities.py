"""Entities of the data model as views over the star-schema tables.

Each function takes (spark, sf_dir) and returns a lazy DataFrame; only the columns
that a query uses reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import PIPELINE_STAGES, monday, where_all

AS_OF = "1998-06-01"
NOW = "1998-06-01 12:00:00"
KPI_NOW = "2024-01-24 12:00:00"
SOURCES = ["salesforce", "hubspot"]
ROLES = ["member", "lead", "admin", "vp", "super_admin", "observer"]


def as_of() -> Column:
    return F.to_date(F.lit(AS_OF))


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def kpi_now() -> Column:
    return F.to_timestamp(F.lit(KPI_NOW))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (index + 1).cast("int"))


def focus_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").alias("area_id"), F.col("r_name").alias("area_name"), F.col("r_regionkey").alias("sort_order"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals of the areas but the first; one has a target of 0."""
    r = table(spark, sf_dir, "region").where("r_regionkey > 0")
    return r.select(F.col("r_regionkey").alias("area_id"), (F.col("r_regionkey") % 4 * 50).alias("target_numeric"), (F.col("r_regionkey") * 17).alias("current_numeric"), (F.col("r_regionkey") * 3).cast("bigint").alias("updated_by_id"))


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their area."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("area_id"))
    return table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey", "left").select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("owner_name"), "area_id")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders alone: their owners' names and areas are projects_with_area's."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), F.concat(F.lit("P"), F.col("o_orderkey") % 7 + 1, F.lit("-"), F.col("o_orderkey")).alias("code"), F.col("o_custkey").alias("owner_id"))


def projects_with_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects(spark, sf_dir).join(owners(spark, sf_dir), "owner_id", "left")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: status by flag pair, priority by line number."""
    flags = F.concat("l_returnflag", "l_linestatus")
    status = (
        F.when(flags == "AF", "Complete").when(flags == "AO", "Not Started").when(flags == "NF", "In Progress")
        .when(flags == "NO", "Waiting on Someone").when(flags == "RF", "Blocked").when(flags == "RO", "Pending Review")
    )
    stamp = F.to_timestamp(F.col("l_shipdate").cast("date"))
    hours = lambda c: F.make_dt_interval(F.lit(0), c.cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("assignee_id"), F.col("l_partkey").alias("part_id"),
        status.alias("status"), pick(["Critical", "High", "Medium", "Low"], F.col("l_linenumber") % 4).alias("priority"),
        F.col("l_shipdate").cast("date").alias("due_date"), (F.col("l_quantity") * 2).cast("int").alias("percent_complete"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 10 + 1).alias("blocked_by_id"),
        F.when(F.col("l_partkey") % 4 == 0, F.col("l_partkey") % 7 + 1).alias("escalated_to_id"),
        F.when(F.col("l_partkey") % 4 == 0, stamp + hours(F.lit(5))).alias("escalated_at"),
        F.when(F.col("l_partkey") % 8 == 0, stamp + hours(F.lit(30))).alias("escalation_resolved_at"),
        F.when(flags == "AF", stamp + hours(F.col("l_quantity") * 3 - 72)).alias("completed_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        key.alias("user_id"), F.col("s_name").alias("user_name"), pick(ROLES, key % 6).alias("role"), (key % 9 != 0).alias("is_active"),
        F.when(key % 5 != 0, F.concat(F.lit("User"), key, F.lit("@Example.com"))).alias("email"),
        F.when(key % 3 == 0, F.lit("")).when(key % 3 == 1, F.concat(F.lit("Name "), key)).alias("display_name"),
        F.when(key % 4 != 0, F.lit("First")).alias("first_name"), F.when(key % 8 < 6, F.lit("Last")).otherwise("").alias("last_name"),
    )


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), pick(SOURCES, k % 2).alias("source_system"), F.concat(F.lit("Opportunity "), k).alias("name"), F.col("o_custkey").alias("account_id"),
        F.concat(F.lit("Owner "), F.nullif(F.col("o_custkey") % 12, F.lit(0))).alias("owner_name"),
        F.when(k % 11 != 0, F.col("o_totalprice").cast("decimal(14,2)")).alias("amount"),
        pick(PIPELINE_STAGES, k % 7).alias("stage_canonical"), F.col("o_orderdate").cast("date").alias("close_date"),
    )


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), pick(SOURCES, k % 2).alias("source_system"), F.col("p_name").alias("name"),
        pick(["Email", "Webinar", "Referral", "Paid Social"], k % 4).alias("channel"), F.col("p_type").alias("type"),
        F.when(k % 13 == 0, 0).otherwise(F.col("p_size") * 10).cast("int").alias("sends"), (F.col("p_size") * 4).cast("int").alias("opens"),
        (k % 30).cast("int").alias("clicks"), F.when(k % 6 != 0, F.col("p_retailprice").cast("decimal(14,2)")).alias("influenced_pipeline"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), pick(SOURCES, k % 2).alias("source_system"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), pick(SOURCES, k % 2).alias("source_system"), F.col("c_name").alias("last_name"), F.col("c_nationkey").alias("account_id"))


def email_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(k.alias("id"), pick(SOURCES, k % 2).alias("source_system"), (k % 200).alias("campaign_id"), F.col("ts").cast("timestamp").alias("sent_at"))


def connections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, "connected") for x in SOURCES], "source_system string, status string")


def source_record(df: DataFrame, source: str, id_: int) -> DataFrame:
    """S-11: one record of one source."""
    return point_lookup(df, source, id_)


def connection_card(connections_: DataFrame, events_: DataFrame, source: str, most: int = 10) -> DataFrame:
    """S-11, V-23: a source's connection with its newest events, by time and id: a limit by key, not a window."""
    newest = events_.where(F.col("source_system") == source).orderBy(F.col("sent_at").desc(), F.col("id").desc()).limit(most)
    return connections_.where(F.col("source_system") == source).join(newest.withColumnRenamed("id", "event_id"), "source_system", "left")


def adapter(spark: SparkSession, sf_dir: str, source: str) -> dict[str, DataFrame]:
    """S-11: what one source lists, all read alike."""
    offered = {"opportunities": opportunities, "campaigns": campaigns, "email_activity": email_activity}
    return {name: read_filtered(f(spark, sf_dir), source_system=source) for name, f in offered.items()}


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users(spark, sf_dir).select((F.col("user_id") % 5).alias("group_id"), "user_id")


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("id"), pick(["pending", "approved", "denied"], k % 3).alias("status"), F.when(k % 3 != 0, F.col("user_id")).alias("decided_by_id"),
        pick(["account", "access"], k % 2).alias("kind"), F.col("user_id").alias("requester_user_id"),
    )


def invitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("id"), F.col("user_id").alias("target_user_id"), pick(["pending", "accepted", "revoked"], k % 3).alias("status"),
        (F.col("ts").cast("timestamp") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"), F.when(k % 4 != 0, F.concat(F.lit("USER"), k % 40, F.lit("@example.com"))).alias("email"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' files as a stream; a pattern, since a stream takes a plain path for a folder."""
    return spark.readStream.schema(events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parque[t]")


def metric_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly counts of events by type and user: metric, user, Monday."""
    e = events(spark, sf_dir).select(F.col("event_type").alias("metric"), "user_id", monday("ts").alias("period_start"), "event_id")
    return e.groupBy("metric", "user_id", "period_start").agg(F.count(F.lit(1)).alias("count"), F.max("event_id").alias("id"), pick(["manual", "salesforce"], F.max("event_id") % 2).alias("source"))


def metric_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users of events, with a role."""
    u = events(spark, sf_dir).select("user_id").distinct()
    return u.select("user_id", pick(ROLES, F.col("user_id") % 6).alias("role"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric for each event type: target by name length, applying to developers, all, or a word that is neither."""
    m = events(spark, sf_dir).select(F.col("event_type").alias("metric")).distinct()
    n = F.length("metric")
    return m.select("metric", n.cast("bigint").alias("target"), pick(["developers", "all", "others"], n % 3).alias("applies_to"))


def read_filtered(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal every value given; None asks for nothing."""
    return df.where(where_all(*(F.col(c) == v for c, v in equal.items() if v is not None)))


def point_lookup(df: DataFrame, source: str, id_: int) -> DataFrame:
    """The record of one source by id."""
    return df.where((F.col("id") == id_) & (F.col("source_system") == source)).limit(1)


def first_match(df: DataFrame, sources: list[str], id_: int) -> DataFrame:
    """The record by id from the first source, in order, that has it."""
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source_system"))
    return df.where((F.col("id") == id_) & F.col("source_system").isin(sources)).withColumn("__rank", rank).orderBy("__rank").limit(1).drop("__rank")
