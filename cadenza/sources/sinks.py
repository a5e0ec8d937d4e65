"""Sinks: JSON, CSV, sheet sets and an HTML brief."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import csv_cell, html_text


def json_rows(df: DataFrame) -> DataFrame:
    """K-1: one JSON text per row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def csv_lines(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """K-2: the lines of a CSV text, the header first; columns are (key, label). Cells are quoted only where they must be."""
    head = df.sparkSession.range(1).select(F.lit(0).alias("part"), F.concat_ws(",", *(csv_cell(F.lit(label)) for _, label in columns)).alias("line"))
    body = df.select(F.lit(1).alias("part"), F.concat_ws(",", *(csv_cell(F.col(k)) for k, _ in columns)).alias("line"))
    return head.unionByName(body)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """K-3: one CSV folder per sheet, written by the executors."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{path}/{name}")


def html_table(df: DataFrame, columns: list[tuple[str, str]], most: int = 500) -> str:
    """K-5: a table of at most `most` rows (a brief for people; it raises beyond that rather than cut)."""
    rows = df.select(*(html_text(F.col(k)).alias(f"c{i}") for i, (k, _) in enumerate(columns))).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a brief holds {most} rows at most")
    head = df.sparkSession.range(1).select(*(html_text(F.lit(label)).alias(f"c{i}") for i, (_, label) in enumerate(columns))).first()
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + line("th", head) + "".join(line("td", r) for r in rows) + "</table>"


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """K-5: one column of an ordered DataFrame as text files, written by the executors: files in order of their names hold the lines in order."""
    df.select(column).write.mode("overwrite").text(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir, which all executors share; where that is unset, a local master (as in tests) uses the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/cadenza-shared"
    return f"{base.rstrip('/')}/cadenza/{name}-{uuid.uuid4().hex}"
