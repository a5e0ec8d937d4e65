"""S-14, J-23, J-24, V-30: what a catalogue says of its tables as a DataFrame of facts, and the lists of a drift report.

A fact is (table_name, kind, name, value). Columns and their nested fields are facts by path, so that a
difference deep in a type is one line. Catalogue tables have no indexes or constraints of their own: those
that are declared as table properties (PREFIXES) are read from there, beside partitions and buckets, and so is
whether a column may be null, since file tables accept null everywhere. Only metadata is read; it is as
large as the catalogue.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X

FACTS = "table_name string, kind string, name string, value string"
#: Property names that declare an index ("unique a,b" or "a,b"), a unique constraint, a foreign key ("a,b -> t(c,d) on delete x") and a column that isn't null.
PREFIXES = {"index.": "index", "unique.": "unique", "foreign.": "foreign key", "not_null.": "not null"}
#: Lists of the report by kind of fact: missing, differing and extra. Extra tables, indexes and constraints only warn.
LISTS = {
    "table": ("missing tables", None, "extra tables"),
    "column": ("missing columns", "column mismatches", "extra columns"),
    "not null": ("column mismatches", "column mismatches", "column mismatches"),
    "default": ("column mismatches", "column mismatches", "column mismatches"),
    "layout": ("index mismatches", "index mismatches", "index mismatches"),
    "index": ("missing indexes", "index mismatches", "extra indexes"),
    "unique": ("missing uniques", "unique mismatches", "extra uniques"),
    "foreign key": ("missing foreign keys", "foreign key mismatches", "extra foreign keys"),
}
WARNINGS = ["extra tables", "extra indexes", "extra uniques", "extra foreign keys"]


def fields(path: str, kind: dict) -> Iterator[tuple[str, str]]:
    """(path, type) of a type as the catalogue describes it, and of all that is nested in it."""
    name = kind["name"]
    if name == "decimal":
        yield path, f"decimal({kind['precision']},{kind['scale']})"
    elif name in ("varchar", "char"):
        yield path, f"{name}({kind['length']})"
    else:
        yield path, name
    if name == "struct":
        for f in kind["fields"]:
            yield from fields(f"{path}.{f['name']}", f["type"])
    elif name == "array":
        yield from fields(f"{path}.element", kind["element_type"])
    elif name == "map":
        yield from fields(f"{path}.key", kind["key_type"])
        yield from fields(f"{path}.value", kind["value_type"])


def table_facts(table: str, described: dict) -> Iterator[tuple[str, str, str, str]]:
    yield table, "table", "", described.get("provider", "")
    for c in described["columns"]:
        for path, kind in fields(c["name"], c["type"]):
            yield table, "column", path, kind
        if c.get("default") is not None:
            yield table, "default", c["name"], c["default"]
    for name in ("partition_columns", "bucket_columns", "sort_columns"):
        if described.get(name):
            yield table, "layout", name, ",".join(described[name])
    for name, value in (described.get("table_properties") or {}).items():
        for prefix, kind in PREFIXES.items():
            if name.startswith(prefix):
                yield table, kind, name.removeprefix(prefix), value


def scan(spark: SparkSession, database: str) -> DataFrame:
    """The facts of all tables of a database (views have none)."""
    found = []
    for t in spark.catalog.listTables(database):
        if not t.isTemporary and t.tableType != "VIEW":
            said = spark.sql(f"DESCRIBE TABLE EXTENDED `{database}`.`{t.name}` AS JSON").first()[0]
            found += table_facts(t.name, json.loads(said))
    return spark.createDataFrame(found, FACTS)


def drift(expected: DataFrame, live: DataFrame) -> DataFrame:
    """list, item (table and name), expected, live and failure of every difference. What a missing or an extra table holds isn't listed again.

    Defaults are compared as literals, without casts and brackets; an expected default of '' only asks that there be one.
    """
    key = ["table_name", "kind", "name"]
    literal = F.when(F.col("kind") == "default", X.default_literal(F.col("value"))).otherwise(F.col("value"))
    side = lambda df, c, flag: df.select(*key, literal.alias(c), F.lit(True).alias(flag))
    both = side(expected, "expected", "__e").join(side(live, "live", "__v"), key, "full_outer")
    one_side = both.where("kind = 'table' AND (__e IS NULL OR __v IS NULL)").select("table_name").distinct()
    shown = both.join(one_side.withColumn("__alone", F.lit(True)), "table_name", "left").where("kind = 'table' OR __alone IS NULL")
    presence = (F.col("kind") == "default") & (F.col("expected") == "") & F.col("__v").isNotNull()
    what = F.when(F.col("__v").isNull(), 0).when(F.col("__e").isNull(), 2).when(~F.col("expected").eqNullSafe(F.col("live")) & ~presence, 1)
    of = F.coalesce(*(F.when((F.col("kind") == kind) & (F.col("__w") == w), name) for kind, names in LISTS.items() for w, name in enumerate(names) if name))
    out = shown.withColumn("__w", what).where("__w IS NOT NULL").withColumn("list", of).where("list IS NOT NULL")
    item = F.when(F.col("name") == "", F.col("table_name")).otherwise(F.concat_ws(".", "table_name", "name"))
    return out.select("list", "kind", item.alias("item"), "expected", "live", (~F.col("list").isin(WARNINGS)).alias("failure"))


def exit_code(lists: DataFrame, strict: bool = False) -> int:
    """0 without drift, 1 with failures (or, if strict, with warnings)."""
    worst = lists.agg(F.bool_or("failure").alias("failure"), F.count(F.lit(1)).alias("n")).first()
    return int(bool(worst["failure"]) or (strict and worst["n"] > 0))


def check(spark: SparkSession, expected: DataFrame, database: str, strict: bool = False) -> tuple[int, DataFrame | None]:
    """Exit code and lists: 2, without lists, where nothing is expected or the catalogue can't be read."""
    if expected.isEmpty():
        return 2, None
    try:
        lists = drift(expected, scan(spark, database))
    except AnalysisException:
        return 2, None
    return exit_code(lists, strict), lists
