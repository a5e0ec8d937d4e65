"""Queries that return whole tables, in order."""

import collections
import re

from cadenza.plans import services, views, whole
from cadenza.sources import sinks

SF = "/root/testdata/sf0.001"


def test_natural_order_holds_all_projects(spark):
    got = [(r["area_id"], [int(x) for x in re.findall(r"\d+", r["code"])]) for r in views.o_5_natural_order_all(spark, SF).collect()]
    assert len(got) == spark.read.parquet(f"{SF}/orders.parquet").count() > 200
    assert got == sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_orders_without_caps_hold_all_rows(spark):
    rows = lambda f: [tuple(r) for r in f(spark, SF).collect()]
    count = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").count()
    many = "/root/testdata/sf0.01"
    assert views.o_6_by_total_all(spark, many).count() == views.o_8_open_then_name_all(spark, many).count() == spark.read.parquet(f"{many}/supplier.parquet").count() > 20
    total, open_, defs = rows(views.o_6_by_total_all), rows(views.o_8_open_then_name_all), rows(views.s_17_definitions_all)
    assert len(defs) == count("orders") > 50
    assert total == sorted(total, key=lambda r: (-r[1], r[0]))
    assert open_ == sorted(open_, key=lambda r: (-r[1], r[2], r[0]))
    newest = sorted(sorted(defs, key=lambda r: (r[2], r[3]), reverse=True), key=lambda r: not r[1])
    assert defs == newest


def test_drill_down_is_an_outline_of_all_tasks(spark):
    out = views.v_15_drill_down_rows(spark, SF).collect()
    levels = collections.Counter(r["level"] for r in out)
    assert levels[2] == spark.read.parquet(f"{SF}/lineitem.parquet").count() and levels[1] == spark.read.parquet(f"{SF}/orders.parquet").count() and levels[0] == 5
    area = project = None
    for r in out:
        if r["level"] == 0:
            area, due = r["area_id"], ""
        elif r["level"] == 1:
            project, due = r["project_key"], ""
        assert r["area_id"] == area and (r["level"] == 0 or r["project_key"] == project)
        if r["level"] == 2:
            assert due <= r["due"]
            due = r["due"]
    assert "drill_down" in views.sheets(spark, SF)


def test_brief_is_written_in_order(spark, tmp_path):
    brief = whole.v_19_brief(spark, SF)
    sinks.write_lines(brief, "html", str(tmp_path / "brief"))
    got = [line for f in sorted((tmp_path / "brief").glob("part-*")) for line in f.read_text().splitlines()]
    assert got == [r["html"] for r in brief.collect()]
    assert got[0].endswith("Tactics</div>") and got[6].startswith("<h2>AFRICA") and got[7].startswith("<h3>P1-")
    assert sum(line.startswith("<h2>") for line in got) == 5


def test_created_definitions_are_never_presets(spark):
    out = whole.rs_15_created(spark, SF)
    assert out.where("created = '1998-06-01' AND is_preset AND name NOT LIKE 'definition %'").count() == 0
    assert out.count() == sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "part"))


def test_the_workbooks_rows_are_not_sorted(spark):
    rows = services.k_3_workbook_rows(spark, SF)
    assert "Sort [" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" in services.workbook(spark, SF)["drill_down"]._jdf.queryExecution().optimizedPlan().toString()
