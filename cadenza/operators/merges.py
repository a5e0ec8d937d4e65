"""M-1: a batch of identity merges over every table that refers to users, published as one version.

Merges may chain (a into b, b into c): pointer doubling finds each account's root in as many rounds as the
depth has binary digits. Every table is read once, with one left join of the roots for each user column
(Spark broadcasts the roots where they are small); each row tells which of its columns moved, so that
counts come from the same pass.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import new_folder

MOVED = "moved_columns"


def written(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resolve(merges: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, root and path of each account that is merged away. merges: source, target, position; users: user_id.

    path: the positions of the merges from the root down to the account. Paths compare as the sequence of merges decides
    which row stays: a nearer account's before those that were merged into it, an earlier branch's before a later one's.
    Raises for accounts that don't exist, merges into oneself, two targets of one source, and cycles.
    """
    edges = written(merges.select(F.col("source").alias("user_id"), F.col("target").alias("root"), F.array(F.col("position").cast("bigint")).alias("path")), "merges")
    both = edges.select(F.explode(F.array("user_id", "root")).alias("user_id")).distinct()
    faults = edges.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("user_id").eqNullSafe(F.col("root"))).alias("own"), F.countDistinct("user_id").alias("sources")).first()
    if both.join(users.select("user_id"), "user_id", "left_anti").limit(1).count():
        raise ValueError("Both accounts must exist to merge")
    if faults["own"]:
        raise ValueError("an account can't be merged into itself")
    if faults["sources"] < faults["n"]:
        raise ValueError("an account is merged twice")
    for _ in range(math.ceil(math.log2(faults["n"] + 1)) + 2):
        up = edges.select(F.col("user_id").alias("root"), F.col("root").alias("__up"), F.col("path").alias("__path"))
        met = edges.join(up, "root", "left")
        if not met.where("__up IS NOT NULL").limit(1).count():
            return edges
        edges = written(met.select("user_id", F.coalesce("__up", "root").alias("root"), F.when(F.col("__up").isNull(), F.col("path")).otherwise(F.concat("__path", "path")).alias("path")), "merges")
    raise ValueError("merges form a cycle")


def repointed(df: DataFrame, columns: list[str], roots: DataFrame) -> DataFrame:
    """df with its user columns at the roots and moved_columns, the names of those that moved."""
    out = df
    for i, c in enumerate(columns):
        out = out.join(roots.select(F.col("user_id").alias(f"__s{i}"), F.col("root").alias(f"__r{i}")), F.col(c) == F.col(f"__s{i}"), "left")
    moved = F.array_compact(F.array(*(F.when(F.col(f"__s{i}").isNotNull(), c) for i, c in enumerate(columns))))
    return out.select(*(F.coalesce(f"__r{columns.index(c)}", c).alias(c) if c in columns else F.col(c) for c in df.columns), moved.alias(MOVED))


def repointed_keyed(df: DataFrame, user: str, keys: list[str], roots: DataFrame) -> DataFrame:
    """The same for a table with a row for each user and key: of rows that come to one key, those of the least path stay. Null keys are never equal."""
    taken = roots.select(F.col("root").alias(user)).union(roots.select("user_id")).distinct()
    plain = df.join(taken, user, "left_anti").withColumn(MOVED, F.array().cast("array<string>"))
    mine = df.join(taken, user, "left_semi").join(roots.withColumnsRenamed({"user_id": user, "root": "__root", "path": "__path"}), user, "left")
    mine = mine.withColumn(MOVED, F.when(F.col("__root").isNotNull(), F.array(F.lit(user))).otherwise(F.array().cast("array<string>")))
    mine = mine.withColumns({user: F.coalesce("__root", user), "__path": F.coalesce("__path", F.array().cast("array<bigint>"))})
    least = F.min("__path").over(Window.partitionBy(user, *keys))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    stay = mine.withColumn("__least", least).where(~known | (F.col("__path") == F.col("__least")))
    return plain.select(*df.columns, MOVED).unionByName(stay.select(*df.columns, MOVED))


def merged_users(users: DataFrame, roots: DataFrame, inherited: list[tuple[str, ...]], cleared: list[str]) -> DataFrame:
    """Users after the merges. inherited: columns that go together; where a root's first of them is empty, the nearest account's that has one is taken.
    Merged accounts are inactive and lose the cleared columns, all else stays their own; roots are active."""
    empty = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")).isNull()
    theirs = users.join(roots, "user_id").groupBy(F.col("root").alias("user_id")).agg(
        *(F.min_by(F.when(~empty(g[0]), F.struct(*g)), F.when(~empty(g[0]), F.col("path"))).alias(f"__g{i}") for i, g in enumerate(inherited)), F.lit(True).alias("__is_root"))
    out = users.join(roots.select("user_id", F.lit(True).alias("__gone")), "user_id", "left").join(theirs, "user_id", "left")
    new = {}
    for i, g in enumerate(inherited):
        for c in g:
            new[c] = F.when(F.col("__is_root") & empty(g[0]) & F.col(f"__g{i}").isNotNull(), F.col(f"__g{i}.{c}")).otherwise(F.col(c))
    gone = F.coalesce("__gone", F.lit(False))
    for c in users.columns:
        if c in cleared:
            new[c] = F.when(~gone, new.get(c, F.col(c)))
    new["is_active"] = F.when(gone, False).when(F.col("__is_root"), True).otherwise(F.col("is_active"))
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in users.columns))


@dataclass
class Merged:
    """users, and every other table by name with its moved_columns."""

    users: DataFrame
    tables: dict[str, DataFrame]

    def moved(self) -> DataFrame:
        """column_name (table.column) and moved rows; columns without any are left out."""
        parts = [df.select(F.explode(MOVED).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("moved")).select(F.concat(F.lit(f"{name}."), "c").alias("column_name"), "moved") for name, df in self.tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def merge_batch(users: DataFrame, merges: DataFrame, referring: dict[str, tuple[DataFrame, list[str]]], keyed: dict[str, tuple[DataFrame, str, list[str]]], inherited: list[tuple[str, ...]], cleared: list[str]) -> Merged:
    roots = resolve(merges, users)
    tables = {name: repointed(df, columns, roots) for name, (df, columns) in referring.items()}
    tables |= {name: repointed_keyed(df, user, keys, roots) for name, (df, user, keys) in keyed.items()}
    return Merged(merged_users(users, roots, inherited, cleared), tables)


# --- versions ---------------------------------------------------------------------------------


def versions_of(spark: SparkSession, root: str) -> tuple:
    """The file system and the pointers to versions, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_versions")
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(at)
    return fs, sorted(f.getPath().getName() for f in fs.listStatus(at) if not f.getPath().getName().startswith("_"))


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Writes all tables as one version, then renames a pointer to the next number: readers see all of them or none.
    Of two that publish at once the later raises, and its version is never seen."""
    fs, before = versions_of(spark, root)
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_versions/{x}")
    out = fs.create(path(f"_{version}"), False)
    out.write(bytearray(version.encode()))
    out.close()
    _, now = versions_of(spark, root)
    if now != before or not fs.rename(path(f"_{version}"), path(f"{len(before):09d}")):
        raise RuntimeError("another version was published meanwhile")
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest version."""
    _, known = versions_of(spark, root)
    return spark.read.parquet(f"{root}/{spark.read.text(f'{root}/_versions/{known[-1]}').first()[0]}/{name}")
