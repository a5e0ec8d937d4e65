"""Facts of a catalogue and every list of the drift report."""

import pytest

from cadenza.operators import drift as V


@pytest.fixture(scope="module")
def database(spark):
    spark.sql("CREATE DATABASE drift_live")
    spark.sql("CREATE TABLE drift_live.t (id bigint, name string DEFAULT 'x', n decimal(9,2) DEFAULT (0), s struct<a: int, b: array<struct<c: string>>>, m map<string, double>, p string) USING parquet PARTITIONED BY (p) TBLPROPERTIES ('unique.u' = 'id', 'index.i' = 'unique id', 'foreign.f' = 'id -> o(id) on delete cascade', 'not_null.id' = 'true', 'other' = '1')")
    spark.sql("CREATE TABLE drift_live.b (k int) USING parquet CLUSTERED BY (k) SORTED BY (k) INTO 4 BUCKETS")
    spark.sql("CREATE VIEW drift_live.v AS SELECT 1 AS one")
    yield "drift_live"
    spark.sql("DROP DATABASE drift_live CASCADE")


FACTS = [
    ("t", "table", "", "parquet"), ("t", "column", "id", "bigint"), ("t", "column", "name", "string"), ("t", "column", "n", "decimal(9,2)"), ("t", "column", "s", "struct"), ("t", "column", "s.a", "int"), ("t", "column", "s.b", "array"),
    ("t", "column", "s.b.element", "struct"), ("t", "column", "s.b.element.c", "string"), ("t", "column", "m", "map"), ("t", "column", "m.key", "string"), ("t", "column", "m.value", "double"), ("t", "column", "p", "string"),
    ("t", "default", "name", "'x'"), ("t", "default", "n", "(0)"), ("t", "layout", "partition_columns", "p"), ("t", "unique", "u", "id"), ("t", "index", "i", "unique id"), ("t", "foreign key", "f", "id -> o(id) on delete cascade"), ("t", "not null", "id", "true"),
    ("b", "table", "", "parquet"), ("b", "column", "k", "int"), ("b", "layout", "bucket_columns", "k"), ("b", "layout", "sort_columns", "k"),
]


def test_facts_are_what_the_catalogue_says(spark, database):
    assert sorted(tuple(r) for r in V.scan(spark, database).collect()) == sorted(FACTS)


def lists(spark, facts, database):
    code, out = V.check(spark, spark.createDataFrame(facts, V.FACTS), database)
    return code, sorted((r["list"], r["item"], r["failure"]) for r in out.collect())


def changed(key, value):
    return [(*f[:3], value) if f[:3] == key else f for f in FACTS if f[:3] != key or value is not None]


@pytest.mark.parametrize(
    "facts, want",
    [
        (FACTS, []),
        ([*FACTS, ("x", "table", "", "parquet"), ("x", "column", "a", "int")], [("missing tables", "x", True)]),
        ([f for f in FACTS if f[0] != "b"], [("extra tables", "b", False)]),
        ([*FACTS, ("t", "column", "z", "int")], [("missing columns", "t.z", True)]),
        (changed(("t", "column", "s.b.element.c"), None), [("extra columns", "t.s.b.element.c", True)]),
        (changed(("t", "column", "n"), "decimal(9,3)"), [("column mismatches", "t.n", True)]),
        (changed(("t", "column", "m.value"), "float"), [("column mismatches", "t.m.value", True)]),
        (changed(("t", "not null", "id"), None), [("column mismatches", "t.id", True)]),
        (changed(("t", "default", "name"), "'y'"), [("column mismatches", "t.name", True)]),
        (changed(("t", "default", "n"), "0::numeric"), []),  # only a cast differs
        (changed(("t", "default", "name"), ""), []),  # any default will do
        (changed(("t", "default", "name"), None), [("column mismatches", "t.name", True)]),
        ([*FACTS, ("t", "default", "id", "1")], [("column mismatches", "t.id", True)]),
        (changed(("t", "index", "i"), "id"), [("index mismatches", "t.i", True)]),
        ([*FACTS, ("t", "index", "j", "name")], [("missing indexes", "t.j", True)]),
        (changed(("t", "index", "i"), None), [("extra indexes", "t.i", False)]),
        (changed(("t", "unique", "u"), "id,name"), [("unique mismatches", "t.u", True)]),
        (changed(("t", "unique", "u"), None), [("extra uniques", "t.u", False)]),
        ([*FACTS, ("b", "unique", "w", "k")], [("missing uniques", "b.w", True)]),
        (changed(("t", "foreign key", "f"), "id -> o(id)"), [("foreign key mismatches", "t.f", True)]),
        (changed(("t", "foreign key", "f"), None), [("extra foreign keys", "t.f", False)]),
        ([*FACTS, ("b", "foreign key", "g", "k -> t(id)")], [("missing foreign keys", "b.g", True)]),
        (changed(("b", "layout", "sort_columns"), None), [("index mismatches", "b.sort_columns", True)]),
    ],
)
def test_every_list(spark, database, facts, want):
    code, got = lists(spark, facts, database)
    assert got == want and code == int(any(f for *_, f in want))


def test_exit_codes(spark, database):
    less = spark.createDataFrame([f for f in FACTS if f[0] != "b"], V.FACTS)
    assert V.check(spark, less, database)[0] == 0 and V.check(spark, less, database, strict=True)[0] == 1
    assert V.check(spark, less.limit(0), database) == (2, None) and V.check(spark, less, "nowhere") == (2, None)
