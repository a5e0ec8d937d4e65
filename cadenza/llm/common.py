"""Helpers that the operators share: columns, Arrow maps and written tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step looks at; a longer text is one step.
STEP_BYTES = 2 << 20


def others(df: DataFrame, added: Iterable[str]) -> list[str]:
    """Names of the columns of df that no added column replaces (Spark's names ignore case)."""
    taken = {c.lower() for c in added}
    return [c for c in df.columns if c.lower() not in taken]


def hidden(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """docs with all columns but those under names that no operator computes."""
    return docs.toDF(*(c if c in keep else f"__own_{i}" for i, c in enumerate(docs.columns)))


def shown(df: DataFrame, docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text"), more: tuple[str, ...] = ()) -> DataFrame:
    """The columns of docs, which hidden() renamed, from df, and more of df's."""
    own = [c if c in keep else f"__own_{i}" for i, c in enumerate(docs.columns)]
    return df.select(*[quoted(c) for c in (*own, *more)]).toDF(*docs.columns, *more)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a local master (as in tests) gets one; a cluster must name its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"{tempfile.gettempdir()}/cadenza-shared"
    return where.rstrip("/")


#: Tables that this thread has written and not dropped, in `paths`.
_kept = threading.local()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cadenza/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _kept.paths = written_so_far() | {path}
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    _kept.paths = written_so_far() - {path}


def written_so_far() -> set[str]:
    return getattr(_kept, "paths", set())


def drop_since(spark: SparkSession, before: set[str]) -> None:
    """Removes what was written since then, once the result that reads it is written itself."""
    for path in written_so_far() - before:
        remove(spark, path)


def least_hashes(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those whose key has the least hash: what is sent to the driver to choose them is about as many."""
    n = df.count()
    scale = 1 << 30
    bound = scale if n <= most else min(scale, int(scale * 1.2 * most / n) + 1)
    place = F.pmod(F.xxhash64(key), F.lit(scale))
    return df.where(place < bound).orderBy(place, key).limit(most)


def ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def arrow_map(df: DataFrame, keep: list[str], text: str, added: list[tuple[str, str]], make: Callable) -> DataFrame:
    """df's kept columns and the added ones, which make(text array) returns as Arrow arrays."""
    inside = [(c, df.schema[c].dataType) for c in keep]
    schema = T.StructType([*(T.StructField(c, t) for c, t in inside), *ddl(", ".join(f"{c} {t}" for c, t in added)).fields])
    names = [*keep, *(c for c, _ in added)]
    place = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                new = make(b.column(place))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(place)), *new], names=names)

    return df.select(*[quoted(c) for c in keep], quoted(text).cast("string").alias("__text")).mapInArrow(run, schema)


class Filter:
    """A Bloom filter of one hash over 64-bit keys, of a bounded number of bits: what misses it is surely not among the keys.

    It saves shuffling what a join would drop; results are the same without it. Beyond about
    MOST_BITS keys nearly all passes.
    """

    MOST_BITS = 1 << 28

    def __init__(self, keys: DataFrame, column: str, spark: SparkSession):
        n = max(1, keys.count())
        self.bits = min(self.MOST_BITS, max(1 << 18, 1 << (16 * n - 1).bit_length()))
        at = F.col(column).bitwiseAND(F.lit(self.bits - 1))
        parts = keys.select(F.shiftright(at, 15).cast("int").alias("part"), at.bitwiseAND(F.lit(32767)).alias("bit"))
        rows = parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # MOST_BITS at most
        table = np.zeros(self.bits // 8, np.uint8)
        for r in rows:
            table[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
        self.sent = spark.sparkContext.broadcast(table)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = keys.astype(np.int64) & np.int64(self.bits - 1)
        return ((self.sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def passing(df: DataFrame, key: Column, only: Filter, missing: bool = False) -> DataFrame:
    """The rows of df whose key, a bigint, may be in the filter, or those whose key is surely missing."""
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = b.filter(pa.array(only.may_hold(b.column(width).to_numpy()) ^ missing))
            if keep.num_rows:
                yield keep.select(list(range(width)))

    return df.select(*[quoted(c) for c in df.columns], key.alias("__key")).mapInArrow(run, df.schema)
