"""The data source crm: equal to the entities' tables, filters pushed, row groups and sources left out."""

import collections

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringContains

from cadenza.sources import crm
from cadenza.sources import entities as E

SF = "/root/testdata/sf0.001"


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name, table", [("opportunities", E.opportunities), ("campaigns", E.campaigns), ("email_activity", E.email_activity)])
def test_source_lists_what_the_tables_hold(spark, name, table):
    want = table(spark, SF)
    got = crm.registered(spark).read.format("crm").option("path", SF).option("object", name).load()
    assert got.dtypes == want.dtypes
    assert counted(got) == counted(want)
    ids = F.col("id").isin(1, 2, 33) | (F.col("id") == 7)
    assert counted(got.where(ids & (F.col("source_system") != "hubspot"))) == counted(want.where(ids & (F.col("source_system") != "hubspot")))


def test_filters_reach_the_reader(spark, capsys):
    crm.Adapter(spark, SF, "hubspot").opportunities("Proposal").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(source_system,hubspot)" in plan and "EqualTo(stage_canonical,Proposal)" in plan
    assert ") Filter" not in plan and "Condition" not in plan  # none is left above the scan
    with pytest.raises(ValueError):
        crm.Adapter(spark, SF, "other")


def test_a_schema_limits_the_columns(spark):
    df = crm.registered(spark).read.format("crm").schema("name string, id bigint").option("path", SF).option("object", "campaigns").load()
    assert df.columns == ["name", "id"]
    assert counted(df) == counted(E.campaigns(spark, SF).select("name", "id"))


@pytest.fixture
def split(tmp_path):
    """Two payload files of many row groups."""
    table = pq.read_table(f"{SF}/orders.parquet").sort_by("o_orderkey")
    (tmp_path / "orders.parquet").mkdir()
    half = table.num_rows // 2
    pq.write_table(table.slice(0, half), tmp_path / "orders.parquet" / "a.parquet", row_group_size=100)
    pq.write_table(table.slice(half), tmp_path / "orders.parquet" / "b.parquet", row_group_size=100)
    return str(tmp_path), table


def reader(path, *filters):
    r = crm.CrmReader({"path": path}, crm.StructType.fromDDL(crm.SCHEMAS["opportunities"]))
    return r, list(r.pushFilters(list(filters)))


def test_partitions_by_source_file_and_row_group(spark, split, monkeypatch):
    path, table = split
    r, left = reader(path)
    assert [(p.system, p.file[-9:], len(p.groups)) for p in r.partitions()] == [(s, f, 8) for f in ("a.parquet", "b.parquet") for s in crm.SYSTEMS]
    monkeypatch.setattr(crm, "SPLIT", 1)
    r, _ = reader(path)
    assert len(r.partitions()) == 32
    key = table["o_orderkey"][750].as_py()
    r, left = reader(path, EqualTo(("id",), key), In(("source_system",), ("hubspot", None)), StringContains(("name",), "x"), IsNotNull(("id",)))
    assert [type(f) for f in left] == [StringContains]
    parts = r.partitions()
    assert len(parts) == 1 and parts[0].system == "hubspot"
    rows = [row for p in parts for b in r.read(p) for row in b.to_pylist()]
    assert [x["id"] for x in rows] == ([key] if key % 2 else [])
    r, _ = reader(path, GreaterThan(("id",), table["o_orderkey"][-1].as_py()))
    assert [list(r.read(p)) for p in r.partitions()] == [[]]  # nothing can pass
    got = crm.registered(spark).read.format("crm").option("path", path).load()
    assert counted(got) == counted(E.opportunities(spark, SF))


def test_missing_payloads_raise(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)not|no such"):
        crm.Adapter(spark, str(tmp_path), "hubspot").campaigns().collect()
