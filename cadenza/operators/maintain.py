"""Data maintenance as pure transformations: new tables from old ones.

Parquet has no updates in place, so each function returns the table as it should be;
the caller writes it beside the old one and swaps the names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def update(df: DataFrame, cond: Column, **new: Column) -> DataFrame:
    """K-7: new values where the condition holds; rows where it is null stay."""
    hit = F.coalesce(cond, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def delete(df: DataFrame, cond: Column) -> DataFrame:
    """K-8."""
    return df.where(~F.coalesce(cond, F.lit(False)))


def cascade(children: DataFrame, parents_gone: DataFrame, key: str) -> DataFrame:
    """K-9: children of deleted parents go."""
    return children.join(parents_gone.select(key).distinct(), key, "left_anti")


def set_null(children: DataFrame, parents_gone: DataFrame, key: str) -> DataFrame:
    """K-9: references to deleted parents become null."""
    gone = parents_gone.select(F.col(key).alias("__k")).distinct().withColumn("__gone", F.lit(True))
    out = children.join(gone, children[key] == gone["__k"], "left")
    return out.withColumn(key, F.when(F.col("__gone"), None).otherwise(F.col(key))).select(*children.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], nulls: tuple[str, ...] = ()) -> DataFrame:
    """K-10: rows of new replace those of their key. Its nulls keep the old values, but replace them in the columns named by
    nulls; columns that new lacks stay."""
    given = [c for c in old.columns if c not in keys and c in new.columns]
    joined = old.join(new.select(*keys, *(F.col(c).alias(f"__{c}") for c in given), F.lit(True).alias("__new")), keys, "full_outer")
    value = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) if c in nulls else F.coalesce(f"__{c}", c)
    return joined.select(*(value(c).alias(c) if c in given else F.col(c) for c in old.columns))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K-11: of new, only rows whose key is absent."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_set(old: DataFrame, key: str, value, new: DataFrame) -> DataFrame:
    """K-12: the rows of one key become exactly the new ones."""
    return old.where(~F.col(key).eqNullSafe(F.lit(value))).unionByName(new)


def audit_rows(before: DataFrame, after: DataFrame, key: str, actor: str, acting_as: str | None = None) -> DataFrame:
    """K-13: one row for each changed row, with its JSON before and after."""
    cols = [c for c in before.columns if c != key]
    b = before.select(key, F.to_json(F.struct(*cols)).alias("before"))
    a = after.select(key, F.to_json(F.struct(*cols, *([F.lit(acting_as).alias("actingAs")] if acting_as else []))).alias("after"), F.to_json(F.struct(*cols)).alias("__plain"))
    return b.join(a, key).where("before <> __plain").select(F.col(key).cast("string").alias("target_id"), F.lit(actor).alias("actor_id"), "before", "after")


def latest(entries: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """W-4: of rows with one key, the one of greatest id."""
    rest = [c for c in entries.columns if c not in keys]
    return entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def merge_references(df: DataFrame, columns: list[str], source, target) -> DataFrame:
    """M-1: references to one user become references to the other."""
    return df.withColumns({c: F.when(F.col(c) == source, F.lit(target)).otherwise(F.col(c)) for c in columns})


def merge_users(users: DataFrame, source, target, referring: dict[str, tuple[DataFrame, list[str]]], keyed: dict[str, tuple[DataFrame, str, list[str]]], inherited: list[str]) -> dict[str, DataFrame]:
    """M-1: one user's records become another's. users: user_id, is_active and the inherited columns (address, login, picture).

    keyed tables (user column, rest of the key) come first: the target's row of a key stays, the source's goes. In referring
    tables the source's references move. The source is retired, without login; the target takes what it lacks and is active.
    The result has "users", every other table by name, and "moved": rows that moved by table and column, none for none.
    """
    found = users.where(F.col("user_id").isin(source, target)).select("user_id").distinct().count()
    if found < 2 or source == target:
        raise ValueError("Both accounts must exist to merge")
    out = {name: merge_keyed(df, user, keys, source, target) for name, (df, user, keys) in keyed.items()}
    out |= {name: merge_references(df, columns, source, target) for name, (df, columns) in referring.items()}
    moved = [moved_counts(df, columns, source).withColumn("column_name", F.concat(F.lit(f"{name}."), "column_name")) for name, (df, columns) in referring.items()]
    moved += [moved_counts(df.where(F.col(user) == source).join(df.where(F.col(user) == target).select(*keys), keys, "left_anti"), [user], source).withColumn("column_name", F.lit(f"{name}.{user}")) for name, (df, user, keys) in keyed.items()]
    one = users.where(F.col("user_id") == source).agg(*(F.first(c).alias(f"__{c}") for c in inherited))
    is_source, is_target = F.col("user_id") == source, F.col("user_id") == target
    new = {c: F.when(is_source, None).when(is_target, F.coalesce(F.nullif(F.col(c), F.lit("")), f"__{c}")).otherwise(F.col(c)) for c in inherited}
    merged = users.crossJoin(one).withColumns(new | {"is_active": F.when(is_source, False).when(is_target, True).otherwise(F.col("is_active"))})
    return out | {"users": merged.select(*users.columns), "moved": reduce(DataFrame.unionByName, moved)}


def propagate(tasks: DataFrame, of: Column, **new: Column) -> DataFrame:
    """M-3: a parent's new values reach its children that are not complete."""
    return update(tasks, of & (F.col("status") != "Complete"), **new)


def raise_escalations(tasks: DataFrame, cond: Column, target, raiser, notes: str | None, now: Column) -> DataFrame:
    """M-4: blocked, in the name of the one who raises, until the target resolves; the assignee stays on record."""
    none = F.lit(None).cast("timestamp")
    return update(tasks.withColumns({"block_notes": F.lit(None).cast("string"), "escalated_by_id": F.lit(None).cast("bigint"), "original_assignee_id": F.lit(None).cast("bigint")}), cond,
        status=F.lit("Blocked"), escalated_to_id=F.lit(target).cast("bigint"), blocked_by_id=F.lit(target).cast("bigint"), escalated_by_id=F.lit(raiser).cast("bigint"),
        original_assignee_id=F.col("assignee_id"), escalated_at=now, escalation_resolved_at=none, block_notes=F.lit(notes))


def kpi_upsert(entries: DataFrame, asked: DataFrame, overrides: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M-6: (verdicts, entries afterwards, audit rows) of asked counts, one for each metric, user and week.

    entries: metric, user_id, period_start, count, note. asked: those, actor_id and actor_role. A member writes own counts
    only; locked weeks need an override, a vp or an admin; a count that grows needs a note; an old note stays where none comes.
    """
    keys = ["metric", "user_id", "period_start"]
    note = F.nullif(F.trim("note"), F.lit(""))
    old = entries.select(*keys, F.col("count").alias("old_count"), F.col("note").alias("old_note"))
    met = week_editable(asked.withColumn("note", note), overrides, now).join(old, keys, "left").withColumn("old_count", F.coalesce("old_count", F.lit(0)))
    verdict = (
        F.when((F.col("actor_role") == "member") & (F.col("actor_id") != F.col("user_id")), "own only")
        .when(~F.col("editable") & ~F.col("actor_role").isin("vp", "admin"), "locked")
        .when((F.col("count") > F.col("old_count")) & F.col("note").isNull(), "evidence").otherwise("written")
    )
    met = met.withColumn("verdict", verdict)
    written = met.where("verdict = 'written'")
    after = upsert(entries, written.select(*keys, "count", "note"), keys)
    audit = written.where("old_count <> count OR note IS NOT NULL").select(*keys, "old_count", F.col("count").alias("new_count"), "note", F.col("actor_id").alias("changed_by_id"))
    return met, after, audit


def moved_counts(df: DataFrame, columns: list[str], source) -> DataFrame:
    """A-31: how many references each column would move; columns with none are left out."""
    one = df.agg(*(F.count_if(F.col(c) == source).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("moved")) for c in columns))).alias("x")).select("x.*").where("moved > 0")


def merge_keyed(df: DataFrame, user: str, keys: list[str], source, target) -> DataFrame:
    """J-17, J-18: the source's rows move, except those whose key the target has already."""
    theirs = df.where(F.col(user) == target).select(*keys)
    moving = df.where(F.col(user) == source).join(theirs, keys, "left_anti").withColumn(user, F.lit(target))
    return df.where((F.col(user) != source) | F.col(user).isNull()).unionByName(moving.select(*df.columns))


#: Links that one request may put on its tasks.
LINKS = 1000


def few_links(links: DataFrame) -> DataFrame:
    """links, broadcast; the plan raises where there are more than LINKS."""
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.lit(1)))
    few = links.limit(LINKS + 1).withColumn("__place", place)
    return F.broadcast(few.where(F.when(F.col("__place") > LINKS, F.raise_error(F.lit("too many links in one request")).cast("boolean")).otherwise(True)).drop("__place"))


def bulk_assign(members: DataFrame, links: DataFrame, description: str, due: Column) -> tuple[DataFrame, DataFrame]:
    """M-2: a task per member, and every link on every task (SO-4: links are those of one request; more than LINKS raise)."""
    links = few_links(links)
    tasks = members.select("user_id").distinct().withColumns({"description": F.lit(description), "status": F.lit("Not Started"), "due_date": due})
    return tasks, tasks.select("user_id").crossJoin(links)


def bulk_assign_group(members: DataFrame, creator: int, links: DataFrame, description: str, due: Column) -> tuple[DataFrame, DataFrame]:
    """M-2: the creator's parent task, a child task for each member, and every link on each; the parent's state is its children's (A-17)."""
    links = few_links(links)
    children, _ = bulk_assign(members, links, description, due)
    children = children.withColumns({"is_group_parent": F.lit(False), "percent_complete": F.lit(0)})
    one = members.sparkSession.range(1).select(F.lit(creator).cast("bigint").alias("user_id"), F.lit(description).alias("description"), F.lit("Not Started").alias("status"), due.alias("due_date"), F.lit(True).alias("is_group_parent"), F.lit(0).alias("percent_complete"))
    tasks = one.unionByName(children)
    return tasks, tasks.select("user_id", "is_group_parent").crossJoin(links)


def refresh(tables: dict[str, DataFrame], source: str, now: Column, counted: tuple[str, ...]) -> tuple[dict[str, DataFrame], DataFrame]:
    """M-5: the source's records of all tables (source_system, synced_at) get the time; one event row with how many of the counted tables' there are."""
    out = {name: update(df, F.col("source_system") == source, synced_at=now) for name, df in tables.items()}
    n = reduce(DataFrame.unionByName, [tables[k].where(F.col("source_system") == source).select("source_system") for k in counted])
    event = n.agg(F.count(F.lit(1)).alias("records_synced")).select(F.lit(source).alias("source_system"), F.lit("success").alias("status"), "records_synced", now.alias("finished_at"))
    return out, event


def decide_requests(requests: DataFrame, users: DataFrame, approved: Column, decider: int, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M-10: (requests, users, new invitations). Only pending requests change: an approved access request raises its user to the role
    asked for (of several, that of the greatest id), an approved account request makes an invitation of seven days."""
    pending = F.col("status") == "pending"
    after = update(requests.withColumn("__new", pending), pending, decided_by_id=F.lit(decider).cast("bigint"), status=F.when(approved, "approved").otherwise("denied"))
    yes = after.where((F.col("status") == "approved") & F.col("__new"))
    raised = yes.where("kind = 'access'").groupBy(F.col("requester_user_id").alias("user_id")).agg(F.max_by("requested_role", "id").alias("__role"))
    people = users.join(raised, "user_id", "left").withColumn("role", F.coalesce("__role", "role")).select(*users.columns)
    invitations = yes.where("kind = 'account'").select(F.col("id").alias("request_id"), F.col("requested_role").alias("role"), F.lit("pending").alias("status"), (now + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    return after.drop("__new"), people, invitations


def accept_invitations(invitations: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """M-12: what each invitation (id, target_user_id, email, status, expires_at) comes to. users: user_id, email, has_login.

    Not pending, or expired: refused. Else its target's row is claimed, or else that of the address in any case (the least id);
    one that has a login is refused; without either a user is made. Claimed and made ones are accepted.
    """
    target = users.select(F.col("user_id").alias("target_user_id"), F.lit(True).alias("__known"), F.col("has_login").alias("__login"))
    by = users.where("email IS NOT NULL").groupBy(F.lower("email").alias("__mail")).agg(F.min(F.struct("user_id", "has_login")).alias("__one"))
    met = invitations.join(target, "target_user_id", "left").join(by, F.lower(invitations["email"]) == F.col("__mail"), "left")
    live = (F.col("status") == "pending") & (F.col("expires_at") > now)
    login = F.when(F.col("__known"), F.col("__login")).otherwise(F.col("__one.has_login"))
    claimed = F.when(F.col("__known"), F.col("target_user_id")).otherwise(F.col("__one.user_id"))
    outcome = F.when(~live, "invalid").when(claimed.isNull(), "insert").when(login, "already claimed").otherwise("claim")
    out = met.withColumn("outcome", outcome).withColumn("user_id", F.when(F.col("outcome") == "claim", claimed))
    return out.select("id", "outcome", "user_id", F.when(F.col("outcome").isin("claim", "insert"), "accepted").otherwise(F.col("status")).alias("status"))


def rows_or_default(held: DataFrame, defaults: DataFrame) -> DataFrame:
    """S-15: the rows of held, or the defaults where there are none at all; which it is is found within the plan."""
    n = held.agg(F.count(F.lit(1)).alias("__held"))  # one row
    return held.unionByName(defaults.crossJoin(F.broadcast(n)).where("__held = 0").select(*held.columns))


def ensure_permissions(held: DataFrame, defaults: DataFrame, always: DataFrame) -> DataFrame:
    """M-11: role and key rows: the defaults where there are none at all, and in any case the rows that must be there."""
    return insert_missing(rows_or_default(held, defaults), always, ["role", "key"])


def role_permissions(held: DataFrame, defaults: DataFrame, roles: list[str]) -> DataFrame:
    """R-1: role, permissions (distinct keys in order): the held rows of known roles; where none are held at all, the defaults. A role without rows has none."""
    by = rows_or_default(held.select("role", "key"), defaults).groupBy("role").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    known = held.sparkSession.createDataFrame([(k, r) for k, r in enumerate(roles)], "position int, role string")
    return known.join(by, "role", "left").select("role", "position", F.coalesce(F.concat_ws(",", "keys"), F.lit("")).alias("permissions"))


def create_definitions(held: DataFrame, asked: DataFrame) -> DataFrame:
    """RS-15: definitions (name, is_preset and others) with those asked for, which are never presets, whatever they say."""
    return held.unionByName(asked.withColumn("is_preset", F.lit(False)))


def gate_completion(tasks: DataFrame, asked: Column, may_approve: bool, now: Column) -> DataFrame:
    """M-3: without the permission, Complete becomes Pending Review; the completion stamp follows the status."""
    status = asked if may_approve else F.when(asked == "Complete", "Pending Review").otherwise(asked)
    done = F.col("status") == "Complete"
    return tasks.withColumn("status", F.coalesce(status, "status")).withColumn("completed_at", F.when(done, F.coalesce("completed_at", now)))


def escalation_target(users: DataFrame, owner: Column, raiser: Column) -> DataFrame:
    """W-3: active admins before vps, then by id, the raiser not among them: the one to escalate to."""
    rank = F.when(F.col("role") == "admin", 0).when(F.col("role") == "vp", 1)
    return users.where(F.col("is_active") & rank.isNotNull() & (F.col("user_id") != raiser)).orderBy(rank, (F.col("user_id") != owner), "user_id").limit(1)


def resolve_escalations(tasks: DataFrame, cond: Column, reassign: Column, now: Column) -> DataFrame:
    """M-4: resolved tasks go back to work with the original or another assignee, their blocks cleared."""
    return update(tasks, cond, assignee_id=F.coalesce(reassign, F.col("assignee_id")), status=F.lit("In Progress"), escalation_resolved_at=now, blocked_by_id=F.lit(None).cast("bigint"))


def kpi_audit(entries: DataFrame) -> DataFrame:
    """W-6, M-6: each change of a weekly count against the week before."""
    w = Window.partitionBy("metric", "user_id").orderBy("period_start")
    old = F.lag("count").over(w)
    return entries.select("metric", "user_id", "period_start", old.alias("old_count"), F.col("count").alias("new_count")).where("old_count IS NULL OR old_count <> new_count")


def effective_invitation(status: Column, expires: Column, now: Column) -> Column:
    """F-19."""
    return F.when((status == "pending") & (expires <= now), "revoked").otherwise(status)


def drift(expected: DataFrame, live: DataFrame) -> DataFrame:
    """J-23: columns (table_name, column_name, type) that one side lacks or types otherwise."""
    e, a = expected.withColumnRenamed("type", "expected"), live.withColumnRenamed("type", "live")
    both = e.join(a, ["table_name", "column_name"], "full_outer")
    what = F.when(F.col("live").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") != F.col("live"), "type")
    return both.withColumn("problem", what).where("problem IS NOT NULL")


def week_editable(periods: DataFrame, overrides: DataFrame, now: Column) -> DataFrame:
    """X-6, X-7: locked, and editable because it isn't or an override row exists."""
    open_ = overrides.select("period_start").distinct().withColumn("__o", F.lit(True))
    out = periods.join(open_, "period_start", "left").withColumn("locked", X.week_locked(F.col("period_start"), now))
    return out.withColumn("editable", ~F.col("locked") | F.col("__o").isNotNull()).drop("__o")


def claim_action(asked: DataFrame, users: DataFrame) -> DataFrame:
    """M-9: asked (id, email) with action and user_id; users: user_id, known (an address), is_active. A null address is new."""
    met = asked.join(users, F.lower("email") == F.lower("known"), "left")
    return met.withColumn("action", F.when(F.col("user_id").isNull(), "insert").when(F.col("is_active"), "reject").otherwise("claim"))
