"""Many reports in one pass against each report by itself."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import report as R
from cadenza.plans import services, whole

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    a = [(rng.choice(["x", "y", None]), rng.choice([1, 2, None]), rng.choice([0.5, -3.0, None]), str(rng.randint(0, 9)) + " or so", rng.choice([True, False])) for _ in range(300)]
    one = spark.createDataFrame(a, "kind string, rank int, amount double, said string, flag boolean").withColumn("price", F.col("amount").cast("decimal(9,2)"))
    return {"one": one, "two": one.select("kind", F.col("rank").alias("level")).limit(20), "none": one.limit(0)}


SPECS = {
    "by kind": R.Spec(["one"], [R.Metric("count"), R.Metric("sum", "amount")], ["kind"]),
    "by both": R.Spec(["one"], [R.Metric("avg", "price"), R.Metric("count", label="n")], ["rank", "kind"]),
    "filtered": R.Spec(["one"], [R.Metric("sum", "said"), R.Metric("avg", "amount")], ["kind"], [R.Filter("rank", "eq", 2), R.Filter("amount", "lt", 1)]),
    "nobody": R.Spec(["one"], [R.Metric("count")], ["kind"], [R.Filter("kind", "in", "x")]),
    "whole": R.Spec(["one"], [R.Metric("sum", "amount"), R.Metric("sum", "missing")], []),
    "mixed": R.Spec(["one", "two", "two"], [R.Metric("count")], ["source", "level", "absent"]),
    "no rows": R.Spec(["none"], [R.Metric("count")], []),
}


def test_reports_together_are_the_reports_alone(tables):
    together = R.run_reports(tables, SPECS).cache()
    for name, spec in SPECS.items():
        got, want = R.report_rows(together, name, spec), R.run_report(tables, spec)
        assert got.columns == want.columns
        plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else v if v is None else str(v) for v in r)
        assert [plain(r) for r in got.collect()] == [plain(r) for r in want.collect()], name


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [")


def test_task_reports_and_presets_read_each_table_once(spark):
    assert scans(whole.a_34_task_reports(spark, SF)) == 1
    assert scans(services.rs_17_presets(spark, SF)) == 2
    by = collections.Counter(r["dimension"] for r in whole.a_34_task_reports(spark, SF).collect())
    assert set(by) == set(whole.DIMENSIONS)
