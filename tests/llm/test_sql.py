"""The registered queries against their SQL on whole tables of the smallest size."""

import collections

import duckdb
import pytest

from cadenza.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = c.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    want = collections.Counter(cur.fetchall())
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert collections.Counter(tuple(r) for r in df.select(*names).collect()) == want
