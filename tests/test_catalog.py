"""Queries against their SQL on the smallest tables; plans without Python."""

import re

import duckdb
import pytest

from cadenza.plans import catalog, oracle, scalars, services, views, whole

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.QUERIES | views.QUERIES | whole.QUERIES | services.QUERIES | scalars.QUERIES, oracle.SQL | views.SQL | whole.SQL | services.SQL | scalars.SQL
#: A fold over ordered rows, and a source of its own.
PYTHON = {"st_4_rate_limit"}
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    return round(float(v), 6)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert len(QUERIES) == len(catalog.QUERIES) + len(views.QUERIES) + len(whole.QUERIES) + len(services.QUERIES) + len(scalars.QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.select(*sorted(df.columns))
    assert name in PYTHON or not re.search("BatchEvalPython|ArrowEvalPython|MapIn", got._jdf.queryExecution().executedPlan().toString())
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    rows = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    key = lambda r: str([(x is not None, str(x)) for x in r])
    assert sorted((tuple(plain(x) for x in r) for r in got.collect()), key=key) == sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)
