"""O-12: pages by seek token over a table that is laid out in the order of its key.

A table is written once, range-partitioned and sorted by the key columns (ascending, nulls last), with a
manifest of each range's first and last key and its rows. A page then reads the ranges it lies in and
nothing else: page one thousand costs what page one does, where an offset would sort a thousand pages.
The key's last column must tell rows apart (an id).
"""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a page.
DEFAULT_SIZE, MOST_SIZE = 25, 200
RANGE = "__range"


def key_of(columns: list[str]) -> Column:
    """The key as a struct that compares as the order does: whether each column is null goes before it."""
    return F.struct(*(x for i, c in enumerate(columns) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"k{i}"))))


def token_of(row: Row, columns: list[str]) -> str:
    """The seek token of a row: where the page after it begins."""
    plain = lambda v: v if v is None or isinstance(v, (bool, int, float, str)) else str(v) if isinstance(v, (dt.date, decimal.Decimal)) else None
    values = [plain(row[c]) for c in columns]
    if any(v is None and row[c] is not None for v, c in zip(values, columns, strict=True)):
        raise TypeError("keys are numbers, texts, dates, times or booleans")
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode()


@dataclass
class Pages:
    """An ordered table: where it lies, its key columns and its schema."""

    spark: SparkSession
    path: str
    columns: list[str]
    schema: T.StructType

    @staticmethod
    def write(df: DataFrame, columns: list[str], path: str, ranges: int) -> Pages:
        order = [F.col(c).asc_nulls_last() for c in columns]
        laid = df.repartitionByRange(ranges, *order).withColumn(RANGE, F.spark_partition_id()).sortWithinPartitions(RANGE, *order)
        laid.write.partitionBy(RANGE).parquet(f"{path}/rows")
        out = Pages(df.sparkSession, path, columns, df.schema)
        key = key_of(columns)
        out.rows().groupBy(RANGE).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/manifest")
        return out

    def rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(RANGE, T.IntegerType())])).parquet(f"{self.path}/rows")

    def manifest(self) -> DataFrame:
        """A row for each range."""
        return self.spark.read.parquet(f"{self.path}/manifest")

    def totals(self, size: int = DEFAULT_SIZE) -> DataFrame:
        """total and pages, from the manifest."""
        return self.manifest().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)))

    def after(self, token: str | None) -> Column:
        """The token's key, of the table's types."""
        values = json.loads(base64.urlsafe_b64decode(token))
        if len(values) != len(self.columns):
            raise ValueError("the token is another table's")
        types = {f.name: f.dataType for f in self.schema}
        return F.struct(*(x for i, (c, v) in enumerate(zip(self.columns, values, strict=True)) for x in (F.lit(v is None).alias(f"n{i}"), F.lit(v).cast(types[c]).alias(f"k{i}"))))

    def page(self, size: int = DEFAULT_SIZE, token: str | None = None) -> DataFrame:
        """The next `size` rows after the token's, in order. A size outside 1 to 200 raises."""
        if not 1 <= size <= MOST_SIZE:
            raise ValueError(f"a page has 1 to {MOST_SIZE} rows")
        ahead, behind = F.lit(True), F.lit(True)
        if token is not None:
            after = self.after(token)
            ahead, behind = F.col("last") > after, key_of(self.columns) > after
        # the first range may have few rows left; the later ones are whole
        need, taken = size, []
        for r in self.manifest().where(ahead).select(RANGE, "n", (F.col("first") > after if token is not None else F.lit(True)).alias("whole")).orderBy(RANGE).toLocalIterator():
            taken.append(r[RANGE])
            need -= r["n"] if r["whole"] else 0
            if need <= 0:
                break
        within = F.col(RANGE).between(taken[0], taken[-1]) if taken else F.lit(False)
        found = self.rows().where(within & behind).orderBy(*(F.col(c).asc_nulls_last() for c in self.columns)).limit(size)
        return found.drop(RANGE)

    def walk(self, size: int = DEFAULT_SIZE, token: str | None = None) -> Iterator[list[Row]]:
        """Page after page."""
        while rows := self.page(size, token).collect():
            yield rows
            if len(rows) < size:
                return
            token = token_of(rows[-1], self.columns)
