"""Report specifications compiled to one DataFrame plan.

A specification names sources, filters, dimensions and metrics. The result follows the
report language's own rules: comparisons with = are strict on type, order comparisons
and sums read the number a value begins with (0 for anything else, null too), averages
divide by all rows, and no input gives no rows even without dimensions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import leading_number

OPERATORS = ("eq", "neq", "in", "notIn", "gt", "gte", "lt", "lte")
AGGREGATES = ("count", "sum", "avg")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Metric:
    agg: str
    field: str | None = None
    label: str | None = None


@dataclass(frozen=True)
class Spec:
    sources: list[str]
    metrics: list[Metric]
    dimensions: list[str] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    #: Carried through, of no effect on the rows.
    group_by: str | None = None
    chart_type: str | None = None

    def __post_init__(self):
        if not self.sources or not self.metrics:
            raise ValueError("a report needs a source and a metric")
        if bad := [f.op for f in self.filters if f.op not in OPERATORS] + [m.agg for m in self.metrics if m.agg not in AGGREGATES]:
            raise ValueError(f"unknown: {', '.join(bad)}")


def union_sources(tables: dict[str, DataFrame], sources: list[str]) -> DataFrame:
    """Rows of the sources in order, tagged; a source named twice counts twice."""
    parts = [tables[s].withColumn("source", F.lit(s)) for s in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def text_of(df: DataFrame, name: str) -> Column:
    """The text that a text-like column has at run time: decimals with their scale, dates as ISO."""
    return F.col(name).cast("string")


def as_number(df: DataFrame, name: str | None) -> Column:
    if name is None or name not in df.columns:
        return F.lit(0.0)
    kind = df.schema[name].dataType
    if isinstance(kind, NUMBERS):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    if isinstance(kind, (T.StringType, T.DecimalType, T.DateType)):
        return F.coalesce(leading_number(text_of(df, name)), F.lit(0.0))
    return F.lit(0.0)


def total_of(df: DataFrame, name: str | None) -> Column:
    """Sum of a field: exact for decimals, whose sum doesn't depend on the order of rows; of doubles for all else."""
    if name in df.columns and isinstance(kind := df.schema[name].dataType, T.DecimalType):
        return F.coalesce(F.sum(F.col(name).cast(T.DecimalType(38, kind.scale))).cast("double"), F.lit(0.0))
    return F.sum(as_number(df, name))


def number_of(value: object) -> float:
    """The same reading of a literal."""
    import math
    import re

    if isinstance(value, bool) or value is None:
        return 0.0
    if isinstance(value, (int, float)):
        return float(value)
    m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", value) if isinstance(value, str) else None
    x = float(m[1]) if m else 0.0
    return x if math.isfinite(x) else 0.0


def equals(df: DataFrame, name: str, value: object) -> Column:
    """Strict equality, never null: types must agree; a missing column equals nothing."""
    if name not in df.columns:
        return F.lit(False)
    if value is None:
        return F.col(name).isNull()
    kind = df.schema[name].dataType
    if isinstance(value, bool):
        return F.coalesce(F.col(name) == F.lit(value), F.lit(False)) if isinstance(kind, T.BooleanType) else F.lit(False)
    if isinstance(value, (int, float)):
        return F.coalesce(F.col(name) == F.lit(value), F.lit(False)) if isinstance(kind, NUMBERS) else F.lit(False)
    if isinstance(value, str) and isinstance(kind, (T.StringType, T.DecimalType, T.DateType)):
        return F.coalesce(text_of(df, name) == F.lit(value), F.lit(False))
    return F.lit(False)


def condition(df: DataFrame, f: Filter) -> Column:
    if f.op == "eq":
        return equals(df, f.field, f.value)
    if f.op == "neq":
        return ~equals(df, f.field, f.value)
    if f.op in ("in", "notIn"):
        if not isinstance(f.value, (list, tuple)):
            return F.lit(False)
        found = reduce(lambda a, b: a | b, (equals(df, f.field, v) for v in f.value), F.lit(False))
        return found if f.op == "in" else ~found
    x, y = as_number(df, f.field), F.lit(number_of(f.value))
    return {"gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y}[f.op]


def metric_key(m: Metric, index: int) -> tuple[str, str]:
    """Key and label of a metric's column."""
    if m.label:
        return m.label, m.label
    if m.agg == "count":
        return "count", "Count"
    name = m.field or "value"
    return f"{m.agg}_{name}_{index}", f"{m.agg}({name})"


def columns_of(spec: Spec) -> list[tuple[str, str, str]]:
    """(key, label, kind) of the result's columns."""
    return [*((d, d, "dimension") for d in spec.dimensions), *((*metric_key(m, i), "metric") for i, m in enumerate(spec.metrics))]


def run_report(tables: dict[str, DataFrame], spec: Spec) -> DataFrame:
    """One row per group, by the first metric downwards, then by the dimensions."""
    df = union_sources(tables, spec.sources)
    for f in spec.filters:
        df = df.where(condition(df, f))
    dims = [(F.col(d).cast("string") if not isinstance(df.schema[d].dataType, NUMBERS) else F.col(d)).alias(d) if d in df.columns else F.lit(None).cast("string").alias(d) for d in spec.dimensions]
    found: dict[str, Column] = {}
    for i, m in enumerate(spec.metrics):
        total = total_of(df, m.field)
        found[metric_key(m, i)[0]] = {"count": F.count(F.lit(1)).cast("double"), "sum": total, "avg": total / F.count(F.lit(1))}[m.agg]
    # a metric whose key is a dimension's name, written later, wins; inside, metrics have names of their own
    inner = {k: f"__m{i}" for i, k in enumerate(found)}
    grouped = df.groupBy(*(dims or [F.lit(1).alias("__one")])).agg(*(c.alias(inner[k]) for k, c in found.items()))
    first = inner[metric_key(spec.metrics[0], 0)[0]]
    ordered = grouped.orderBy(F.col(first).desc(), *(F.col(d).asc_nulls_first() for d in spec.dimensions))
    return ordered.select(*(d for d in spec.dimensions if d not in found), *(F.col(inner[k]).alias(k) for k in found))


def run_reports(tables: dict[str, DataFrame], specs: dict[str, Spec]) -> DataFrame:
    """Many reports, each source list read once: report, dims (values in the specification's order, as text) and metrics.

    Reports over equal sources share one aggregate with a grouping set for each list of dimensions. Where
    their filters differ, the scan takes the rows of any and each metric its own; a group without a row of a
    report's own is not in it. Equal metrics are computed once. `report_rows` gives one report as run_report does.
    """
    groups: dict[tuple, dict[str, Spec]] = {}
    for name, spec in specs.items():
        groups.setdefault(tuple(spec.sources), {})[name] = spec
    return reduce(DataFrame.unionByName, [one_pass(tables, list(sources), group) for sources, group in groups.items()])


def one_pass(tables: dict[str, DataFrame], sources: list[str], specs: dict[str, Spec]) -> DataFrame:
    df = union_sources(tables, sources)
    conditions: dict[str, Column] = {}
    for spec in specs.values():
        conditions.setdefault(repr(spec.filters), reduce(lambda a, b: a & b, (condition(df, f) for f in spec.filters), F.lit(True)))
    flags = {key: f"__f{k}" for k, key in enumerate(conditions)}
    dims = list(dict.fromkeys(d for spec in specs.values() for d in spec.dimensions))
    cells = {d: f"__d{k}" for k, d in enumerate(dims)}
    wanted = list(dict.fromkeys((m.agg, m.field if m.agg != "count" else None, repr(s.filters)) for s in specs.values() for m in s.metrics))
    fields = {f: f"__x{k}" for k, f in enumerate(dict.fromkeys(f for a, f, _ in wanted if a != "count"))}
    exact = {f: df.schema[f].dataType if f in df.columns and isinstance(df.schema[f].dataType, T.DecimalType) else None for f in fields}
    seen = df.where(reduce(lambda a, b: a | b, conditions.values())).select(
        *(c.alias(flags[k]) for k, c in conditions.items()),
        *((F.col(d).cast("string") if d in df.columns else F.lit(None).cast("string")).alias(n) for d, n in cells.items()),
        *((F.col(f).cast(T.DecimalType(38, exact[f].scale)) if exact[f] else as_number(df, f)).alias(n) for f, n in fields.items()),
    )

    def value(agg: str, field: str | None, key: str) -> Column:
        n = F.count_if(F.col(flags[key]))
        if agg == "count":
            return n.cast("double")
        total = F.coalesce(F.sum(F.when(F.col(flags[key]), F.col(fields[field]))).cast("double"), F.lit(0.0))
        return total if agg == "sum" else F.when(n > 0, total / n)

    made = [value(*w).alias(f"__m{k}") for k, w in enumerate(wanted)]
    made += [F.count_if(F.col(f)).alias(f"__n{f}") for f in flags.values()]
    sets = list(dict.fromkeys(tuple(spec.dimensions) for spec in specs.values()))
    if dims:
        grouped = seen.groupingSets([[F.col(cells[d]) for d in s] for s in sets], *(F.col(c) for c in cells.values())).agg(F.grouping_id().alias("__set"), *made)
    else:
        grouped = seen.groupBy(F.lit(0).cast("bigint").alias("__set")).agg(*made)

    def one(name: str, spec: Spec) -> Column:
        left_out = sum(1 << (len(dims) - 1 - k) for k, d in enumerate(dims) if d not in spec.dimensions)
        key = repr(spec.filters)
        values = F.array(*(F.col(f"__m{wanted.index((m.agg, m.field if m.agg != 'count' else None, key))}") for m in spec.metrics))
        row = F.struct(F.lit(name).alias("report"), F.array(*(F.col(cells[d]) for d in spec.dimensions)).cast("array<string>").alias("dims"), values.alias("metrics"))
        return F.when((F.col("__set") == left_out) & (F.col(f"__n{flags[key]}") > 0), row)

    return grouped.select(F.explode(F.array_compact(F.array(*(one(n, s) for n, s in specs.items())))).alias("r")).select("r.*")


def report_rows(reports: DataFrame, name: str, spec: Spec) -> DataFrame:
    """One report's rows of run_reports, in order, under the specification's keys; dimensions are text."""
    at = lambda c, k: F.element_at(c, k + 1)
    mine = reports.where(F.col("report") == name).orderBy(at("metrics", 0).desc(), *(at("dims", k).asc_nulls_first() for k in range(len(spec.dimensions))))
    metrics = {metric_key(m, i)[0]: at("metrics", i) for i, m in enumerate(spec.metrics)}
    return mine.select(*(at("dims", k).alias(d) for k, d in enumerate(spec.dimensions) if d not in metrics), *(c.alias(k) for k, c in metrics.items()))


# The four presets.
PRESETS = {
    "pipeline_by_stage": Spec(["opportunities"], [Metric("sum", "amount", "value")], ["stage_canonical"]),
    "pipeline_by_source": Spec(["opportunities"], [Metric("sum", "amount", "value")], ["source_system"]),
    "influenced_pipeline": Spec(["campaigns"], [Metric("sum", "influenced_pipeline", "influenced")], ["channel"]),
    "open_by_owner": Spec(["opportunities"], [Metric("count", label="n")], ["owner_name"], [Filter("stage_canonical", "notIn", ["Closed Won", "Closed Lost"])]),
}
