"""K-10, M-5, ST-3: tables kept in buckets of their key, of which a change reads and writes those it touches.

A version of a table is a manifest: for each bucket the folder that holds it. A merge writes new folders for the
touched buckets and then publishes the next manifest by one rename; a merge that dies is never seen, and one
that is run again for its epoch does nothing. Rollups are kept by signed deltas: what a row counted for is
taken back, what it counts for now is added.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import new_folder
from .maintain import upsert
from .merges import versions_of
from .rollups import COUNTS, task_counts

BUCKET = "__bucket"


@dataclass
class Buckets:
    """A table at root, of a schema, dealt to buckets by its key."""

    spark: SparkSession
    root: str
    key: list[str]
    schema: T.StructType
    buckets: int = 64

    def manifest(self) -> dict:
        """{"epoch": the newest one merged, or null, "folders": {bucket: folder}}"""
        _, known = versions_of(self.spark, self.root)
        if not known:
            return {"epoch": None, "folders": {}}
        return json.loads(self.spark.read.text(f"{self.root}/_versions/{known[-1]}").first()[0])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of the newest version, of all buckets or of some."""
        folders = self.manifest()["folders"]
        paths = [f"{self.root}/{folders[b]}/{BUCKET}={b}" for b in sorted(folders, key=int) if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, changes: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], epoch: int | None = None) -> list[int]:
        """Puts fold(rows of the touched buckets, changes) in place of those buckets; returns them. changes have the key's columns.

        An epoch that is not after the newest merged one was merged before: nothing happens.
        """
        before, known = self.manifest(), versions_of(self.spark, self.root)[1]
        if epoch is not None and before["epoch"] is not None and epoch <= before["epoch"]:
            return []
        path = new_folder(self.spark, "changes")
        changes.withColumn(BUCKET, self.bucket()).write.parquet(path)
        held = self.spark.read.schema(T.StructType([*changes.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)
        touched = sorted(r[0] for r in held.select(BUCKET).distinct().collect())  # as many as there are buckets, at most
        folder = uuid.uuid4().hex
        if touched:
            rows = fold(self.read(touched), held.drop(BUCKET)).select(*self.schema.names)
            rows.withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        fs, now = versions_of(self.spark, self.root)
        at = lambda x: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{x}")
        kept = {b: f for b, f in before["folders"].items() if int(b) not in touched}
        kept |= {str(b): folder for b in touched if fs.exists(at(f"{folder}/{BUCKET}={b}"))}  # a bucket may have lost its last row
        said = json.dumps({"epoch": before["epoch"] if epoch is None else epoch, "folders": kept})
        out = fs.create(at(f"_versions/_{folder}"), False)
        out.write(bytearray(said.encode()))
        out.close()
        if now != known or not fs.rename(at(f"_versions/_{folder}"), at(f"_versions/{len(known):09d}")):
            raise RuntimeError("another version was published meanwhile")
        return touched

    def upsert(self, new: DataFrame, nulls: tuple[str, ...] = (), epoch: int | None = None) -> list[int]:
        """K-10 on the touched buckets alone."""
        return self.merge(new, lambda old, rows: upsert(old, rows, self.key, nulls), epoch)


# --- rollups from deltas ------------------------------------------------------------------------


def rollup_state(spark: SparkSession, root: str, key: list[tuple[str, str]], buckets: int = 64) -> Buckets:
    """An empty state of task counts by key, (name, type) pairs."""
    schema = T.StructType.fromDDL(", ".join([*(f"{c} {t}" for c, t in key), *(f"{c} bigint" for c in COUNTS)]))
    return Buckets(spark, root, [c for c, _ in key], schema, buckets)


def delta(before: DataFrame | None, after: DataFrame | None, by: list[str], as_of: Column) -> DataFrame:
    """Signed counts by key: those of the tasks as they are now less those of the same tasks as they were."""
    parts = []
    for tasks, sign in ((before, -1), (after, 1)):
        if tasks is not None:
            parts.append(task_counts(tasks, by, as_of).select(*by, *((F.col(c) * sign).cast("bigint").alias(c) for c in COUNTS)))
    return added(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), by)


def grown_older(tasks: DataFrame, by: list[str], old: Column, new: Column) -> DataFrame:
    """The delta of a later date: open tasks that fell due meanwhile are overdue. Only the due dates between are asked for."""
    late = tasks.where((F.col("due_date") >= old) & (F.col("due_date") < new) & (F.col("status") != "Complete"))
    return late.groupBy(*by).agg(*((F.count(F.lit(1)) if c == "overdue_count" else F.lit(0).cast("bigint")).alias(c) for c in COUNTS))


def added(counts: DataFrame, by: list[str]) -> DataFrame:
    """Sums by key; keys without tasks are gone."""
    out = counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in COUNTS))
    return out.where(" OR ".join(f"{c} <> 0" for c in COUNTS))


def apply_delta(state: Buckets, signed: DataFrame, epoch: int | None = None) -> list[int]:
    """Merges signed counts into the state; returns the buckets that were read and written."""
    return state.merge(signed, lambda old, d: added(old.unionByName(d.select(*old.columns)), state.key), epoch)
