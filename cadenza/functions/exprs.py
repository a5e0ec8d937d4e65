"""Column builders: rounding, dates, coercions, predicates and status ladders.

Points in time are arguments: as_of is a date, now a timestamp, both columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies of the data model.
TASK_STATUS = ["Not Started", "In Progress", "Waiting on Someone", "Blocked", "Pending Review", "Complete"]
TASK_PRIORITY = ["Critical", "High", "Medium", "Low"]
PIPELINE_STAGES = ["Prospecting", "Qualification", "Discovery", "Proposal", "Negotiation", "Closed Won", "Closed Lost"]
CLOSED_STAGES = ["Closed Won", "Closed Lost"]
PROJECT_STATUS = ["No Tasks", "Not Started", "In Progress", "At Risk", "Blocked", "Complete"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, null where the whole is null or 0."""
    return F.when(whole != 0, round_half_up(part * 100 / whole))


def money(x: Column | str) -> Column:
    """Exact cents, so that sums don't depend on the order of rows."""
    return F.coalesce(col(x).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def where_all(*terms: Column | None) -> Column:
    """Conjunction of the terms that are given."""
    return reduce(lambda a, b: a & b, [t for t in terms if t is not None], F.lit(True))


def monday(at: Column | str) -> Column:
    """The Monday of the week (Sundays belong to the Monday before)."""
    return F.date_trunc("week", col(at)).cast("date")


def prior_monday(at: Column, weeks: int) -> Column:
    return F.date_sub(monday(at), 7 * weeks)


def lock_time(now: Column) -> Column:
    """This week's Monday, 09:00."""
    return F.date_trunc("week", now) + F.expr("INTERVAL 9 HOURS")


def week_locked(period: Column, now: Column) -> Column:
    return (period < monday(now)) & (now >= lock_time(now))


def overdue(status: Column, due: Column, as_of: Column) -> Column:
    return F.coalesce((status != "Complete") & (due < as_of), F.lit(False))


def due_soon(status: Column, due: Column, as_of: Column) -> Column:
    """Due within seven days, both ends included."""
    return F.coalesce((status != "Complete") & due.between(as_of, F.date_add(as_of, 7)), F.lit(False))


def overdue_now(status: Column, due: Column, now: Column) -> Column:
    """The snapshot's variant: a task due today is overdue after midnight."""
    return F.coalesce((status != "Complete") & (due.cast("timestamp") < now), F.lit(False))


def active_escalation(at: Column, resolved: Column) -> Column:
    return at.isNotNull() & resolved.isNull()


def project_status(n: Column, blocked: Column, late: Column, complete: Column, active: Column) -> Column:
    """Blocked, then late, then complete, then active."""
    return (
        F.when(n == 0, "No Tasks").when(blocked > 0, "Blocked").when(late > 0, "At Risk")
        .when(complete == n, "Complete").when(active > 0, "In Progress").otherwise("Not Started")
    )


def parent_status(n: Column, blocked: Column, complete: Column, active: Column) -> Column:
    """Complete, then blocked, then active; null without children."""
    return F.when(n == 0, None).when(complete == n, "Complete").when(blocked > 0, "Blocked").when(active > 0, "In Progress").otherwise("Not Started")


def initiative_status(n: Column, complete: Column, red: Column, amber: Column) -> Column:
    return F.when(n == 0, "No Tasks").when(complete == n, "Complete").when(red > 0, "Blocked").when(amber > 0, "At Risk").otherwise("On Track")


def health(status: Column) -> Column:
    return (
        F.when(status.isin("Blocked", "At Risk"), "red").when(status.isin("Complete", "In Progress"), "green")
        .when(status == "Not Started", "amber").otherwise("gray")
    )


def active_status(status: Column) -> Column:
    return status.isin("In Progress", "Waiting on Someone", "Pending Review")


def leading_number(text: Column) -> Column:
    """The number that a text begins with, after white space; 0 without one, or for one that isn't finite."""
    found = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    number = F.nullif(found, F.lit("")).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number).otherwise(F.lit(0.0))


def display_name(display: Column, first: Column, last: Column, email: Column, id_: Column) -> Column:
    full = F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))
    return (
        F.when(F.length(display) > 0, display).when(F.length(full) > 0, full)
        .when(F.length(email) > 0, F.substring_index(email, "@", 1)).otherwise(F.substring(id_, 1, 8))
    )


def days_vs_due(done: Column, due: Column) -> Column:
    """'n early' up to the due day, 'n late' after it."""
    days = round_half_up((F.unix_micros(done) - F.unix_micros(due.cast("timestamp"))) / 86400e6)
    return F.when(days <= 0, F.concat((-days).cast("string"), F.lit(" early"))).otherwise(F.concat(days.cast("string"), F.lit(" late")))


def natural_key(code: Column) -> Column:
    """Orders P1-2 before P1-10: runs of digits padded to one width."""
    parts = F.regexp_extract_all(code, F.lit(r"(\d+|\D+)"), 1)
    return F.concat_ws("", F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)))


def csv_cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def html_text(value: Column) -> Column:
    """The five entities."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def notes(blocker: Column, roadblock: Column, following: Column) -> Column:
    """The parts that are there, joined by a bullet."""
    part = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws(" • ", part("Blocker", blocker), part("Roadblock", roadblock), part("Next", following))


def short_label(text: Column, most: int = 18) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def initials(name: Column) -> Column:
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: F.length(w) > 0)
    two = F.concat(F.substring(F.element_at(words, 1), 1, 1), F.substring(F.element_at(words, -1), 1, 1))
    return F.upper(F.when(F.size(words) > 1, two).otherwise(F.substring(F.trim(name), 1, 2)))


def slug(text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")))


def due_colour(due: Column, as_of: Column) -> Column:
    return F.when(due < as_of, "destructive").when(due <= F.date_add(as_of, 7), "warning").otherwise("muted")


def web_link(url: Column) -> Column:
    """https:// before what has no scheme of the web."""
    return F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def stale(synced: Column, now: Column) -> Column:
    return synced.isNull() | (now - synced > F.expr("INTERVAL 24 HOURS"))


def applies_to(applies: Column, role: Column) -> Column:
    """Breakdown form: developers means members and leads, all else everybody."""
    return F.when(applies == "developers", role.isin("member", "lead")).otherwise(True)


def applies_this_week(applies: Column, role: Column) -> Column:
    """This-week form: an unknown word means nobody."""
    return F.when(applies == "all", True).when(applies == "developers", role.isin("member", "lead")).otherwise(False)


def canonical_type(name: Column) -> Column:
    """X-30: one spelling for each SQL type; the size stays, without blanks."""
    size = F.replace(F.regexp_extract(name, r"\(.*\)", 0), F.lit(" "), F.lit(""))
    word = F.lower(F.trim(F.regexp_replace(name, r"\(.*\)", "")))
    # Short names of SQL types.
    known = {"serial": "integer", "int": "integer", "int4": "integer", "int8": "bigint", "bool": "boolean", "varchar": "character varying", "timestamptz": "timestamp with time zone", "timestamp": "timestamp without time zone", "decimal": "numeric"}
    full = F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), word)
    return F.concat(F.coalesce(full, word), size)


def clamped_limit(asked: int | None, usual: int = 200, most: int = 500) -> int:
    """O-11: the number of rows for a request: none, or 0, asks for the usual number."""
    return min(max(asked or usual, 1), most)


def currency(x: Column) -> Column:
    """X-17: dollars without cents, halves away from zero; a dash for null and for what is no number."""
    whole = F.round(x.cast("double"))
    shown = F.concat(F.when(whole < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(whole), 0))
    return F.when(x.isNull() | F.isnan(x.cast("double")), "—").otherwise(shown)


def compact_currency(x: Column) -> Column:
    """X-17: dollars in thousands, millions, billions or trillions with one digit, which is left out if 0; what rounds up to the next unit takes it."""
    size = F.abs(x.cast("double"))
    text = F.format_string("%.1f", size)
    for unit, name in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        text = F.when(size >= unit * (1 - (5e-5 if unit > 1e3 else 5e-5)), F.concat(F.regexp_replace(F.format_number(F.round(size / unit, 1), 1), r"\.0$", ""), F.lit(name))).otherwise(text)
    text = F.when(size < 1e3 * (1 - 5e-5), F.regexp_replace(F.format_number(F.round(size, 1), 1), r"\.0$", "")).otherwise(text)
    return F.when(x.isNull() | F.isnan(x.cast("double")), "—").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), text))


def freshness(synced: Column, now: Column) -> Column:
    """X-27: how long ago, in the largest whole unit of minutes, hours, days or months of thirty days."""
    minutes = F.floor((F.unix_seconds(now) - F.unix_seconds(synced)) / 60)
    n = F.when(minutes < 60, minutes).when(minutes < 1440, F.floor(minutes / 60)).when(minutes < 43200, F.floor(minutes / 1440)).otherwise(F.floor(minutes / 43200))
    unit = F.when(minutes < 60, "minute").when(minutes < 1440, "hour").when(minutes < 43200, "day").otherwise("month")
    shown = F.when(minutes < 1, "synced less than a minute ago").otherwise(F.concat(F.lit("synced "), n.cast("string"), F.lit(" "), unit, F.when(n == 1, "").otherwise("s"), F.lit(" ago")))
    return F.when(synced.isNull(), "never synced").otherwise(shown)


def spark_heights(values: Column, target: Column) -> Column:
    """X-28: each value's share of the greatest of the values, the target and 1."""
    top = F.greatest(F.array_max(values), target, F.lit(1)).cast("double")
    return F.transform(values, lambda v: v / top)


def default_literal(text: Column) -> Column:
    """X-30: a column default without casts and the parentheses around it: ('x'::text) is 'x'."""
    plain = F.trim(F.regexp_replace(text, r"::[A-Za-z_ ]+(\([0-9, ]*\))?(\[\])?", ""))
    for _ in range(2):
        plain = F.trim(F.regexp_replace(plain, r"^\((.*)\)$", "$1"))
    return plain


def audit_value(text: Column, acting_as: Column) -> Column:
    """X-26: a JSON object with actingAs, if there is one; a scalar or an array becomes the object's value."""
    object_ = F.when(text.rlike(r"^\s*\{"), F.trim(text)).otherwise(F.concat(F.lit('{"value":'), F.coalesce(text, F.lit("null")), F.lit("}")))
    added = F.concat(F.regexp_replace(object_, r"\}\s*$", ""), F.when(object_.rlike(r"^\{\s*\}$"), "").otherwise(","), F.lit('"actingAs":'), F.to_json(F.struct(acting_as.alias("x"))).substr(F.lit(6), F.length(acting_as) + 2), F.lit("}"))
    return F.when(acting_as.isNull(), object_).otherwise(added)
