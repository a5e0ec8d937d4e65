"""Pages by seek token: every row once, in order, from few files."""

import re

import pytest
from pyspark.sql import functions as F

from cadenza.operators.pages import Pages, token_of
from cadenza.plans import services

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    rows = [(i, None if i % 5 == 0 else f"owner {i % 7}", None if i % 3 else i * 0.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, owner string, amount double").repartition(6)
    return Pages.write(df, ["owner", "amount", "id"], str(tmp_path_factory.mktemp("pages") / "t"), 8), rows


def key(r):
    return (r[1] is None, r[1] or "", r[2] is None, r[2] or 0.0, r[0])


@pytest.mark.parametrize("size", [7, 100, 200])
def test_walking_all_pages_gives_every_row_once_in_order(pages, size):
    p, rows = pages
    got = list(p.walk(size))
    assert all(len(x) == size for x in got[:-1])
    assert [tuple(r) for page in got for r in page] == sorted(rows, key=key)


def test_a_page_reads_few_files(pages):
    p, rows = pages
    assert p.manifest().count() == 8
    deep = sorted(rows, key=key)[900]
    df = p.page(25, token_of(dict(zip(("id", "owner", "amount"), deep, strict=True)), p.columns))
    files = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", df._jdf.queryExecution().executedPlan().toString())[1]
    assert "__range" in files
    assert len(df.inputFiles()) == 8 and df.select(F.input_file_name()).distinct().count() <= 2
    assert [tuple(r) for r in df.collect()] == sorted(rows, key=key)[901:926]


def test_ends_and_faults(pages, spark, tmp_path):
    p, rows = pages
    last = p.page(200, None)
    assert last.count() == 200
    end = sorted(rows, key=key)[-1]
    assert p.page(10, token_of(dict(zip(("id", "owner", "amount"), end, strict=True)), p.columns)).count() == 0
    assert p.totals(30).first()[:] == (1000, 34)
    for size in (0, 201):
        with pytest.raises(ValueError):
            p.page(size)
    with pytest.raises(ValueError):
        p.page(5, token_of({"a": 1}, ["a"]))
    empty = Pages.write(spark.createDataFrame([], "id bigint"), ["id"], str(tmp_path / "none"), 3)
    assert list(empty.walk()) == [] and empty.totals().first()[:] == (0, 1)


def test_projects_come_by_area_and_id(spark):
    got = [(r["sort_order"] is None, r["sort_order"] or 0, r["project_id"]) for r in services.o_2_all_projects(spark, SF).collect()]
    assert len(got) == spark.read.parquet(f"{SF}/orders.parquet").count() and got == sorted(got)
