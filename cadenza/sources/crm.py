"""The connector seam as a Spark data source: spark.read.format("crm") lists the records of CRM systems.

Options: path (the folder of payload files) and object (opportunities, campaigns or email_activity).
Partitions are planned for each source, file and run of row groups; equality and order on the
columns of PUSHED reach the reader, which leaves out sources, row groups (by their statistics)
and rows. A schema given to the reader limits the columns that are made and read. Payloads are
mapped to the canonical columns batch by batch, so a task holds one batch.

Files are opened by pyarrow: local paths, or a scheme that pyarrow's file systems know.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need this package on no path

#: The systems, and the words of their payloads.
SYSTEMS = ["salesforce", "hubspot"]
STAGES = ["Prospecting", "Qualification", "Discovery", "Proposal", "Negotiation", "Closed Won", "Closed Lost"]
CHANNELS = ["Email", "Webinar", "Referral", "Paid Social"]

SCHEMAS = {
    "opportunities": "id bigint, source_system string, name string, account_id bigint, owner_name string, amount decimal(14,2), stage_canonical string, close_date date",
    "campaigns": "id bigint, source_system string, name string, channel string, type string, sends int, opens int, clicks int, influenced_pipeline decimal(14,2)",
    "email_activity": "id bigint, source_system string, campaign_id bigint, sent_at timestamp",
}
#: Where an object's payloads lie, and the payload's id.
FILES = {"opportunities": ("orders.parquet", "o_orderkey"), "campaigns": ("part.parquet", "p_partkey"), "email_activity": ("events.parquet", "event_id")}
PUSHED = {"id", "source_system", "stage_canonical", "campaign_id"}
#: Row groups of about as many bytes make a partition.
SPLIT = 128 << 20


def words(names: list[str], at: np.ndarray) -> pa.Array:
    return pa.array(names).take(pa.array(at))


def dollars(x: pa.Array) -> pa.Array:
    return pc.round(x, 2).cast(pa.decimal128(14, 2))


#: For each object and canonical column: the payload's columns and how to make it of them.
MAPS = {
    "opportunities": {
        "id": (["o_orderkey"], lambda k: k.cast(pa.int64())),
        "source_system": (["o_orderkey"], lambda k: words(SYSTEMS, k.to_numpy() % 2)),
        "name": (["o_orderkey"], lambda k: pc.binary_join_element_wise("Opportunity", k.cast(pa.string()), " ")),
        "account_id": (["o_custkey"], lambda k: k.cast(pa.int64())),
        "owner_name": (["o_custkey"], lambda k: pc.binary_join_element_wise("Owner", pa.array([str(x) if x else None for x in (k.to_numpy() % 12).tolist()], pa.string()), " ")),
        "amount": (["o_orderkey", "o_totalprice"], lambda k, x: pc.if_else(pa.array(k.to_numpy() % 11 != 0), dollars(x), pa.scalar(None, pa.decimal128(14, 2)))),
        "stage_canonical": (["o_orderkey"], lambda k: words(STAGES, k.to_numpy() % 7)),
        "close_date": (["o_orderdate"], lambda x: x.cast(pa.timestamp("us")).cast(pa.date32(), safe=False)),
    },
    "campaigns": {
        "id": (["p_partkey"], lambda k: k.cast(pa.int64())),
        "source_system": (["p_partkey"], lambda k: words(SYSTEMS, k.to_numpy() % 2)),
        "name": (["p_name"], lambda x: x),
        "channel": (["p_partkey"], lambda k: words(CHANNELS, k.to_numpy() % 4)),
        "type": (["p_type"], lambda x: x),
        "sends": (["p_partkey", "p_size"], lambda k, n: pa.array(np.where(k.to_numpy() % 13 == 0, 0, n.to_numpy() * 10).astype(np.int32))),
        "opens": (["p_size"], lambda n: pa.array((n.to_numpy() * 4).astype(np.int32))),
        "clicks": (["p_partkey"], lambda k: pa.array((k.to_numpy() % 30).astype(np.int32))),
        "influenced_pipeline": (["p_partkey", "p_retailprice"], lambda k, x: pc.if_else(pa.array(k.to_numpy() % 6 != 0), dollars(x), pa.scalar(None, pa.decimal128(14, 2)))),
    },
    "email_activity": {
        "id": (["event_id"], lambda k: k.cast(pa.int64())),
        "source_system": (["event_id"], lambda k: words(SYSTEMS, k.to_numpy() % 2)),
        "campaign_id": (["event_id"], lambda k: pa.array(k.to_numpy() % 200, pa.int64())),
        "sent_at": (["ts"], lambda x: x.cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))),
    },
}


def mask_of(f: Filter, column: pa.Array) -> pa.Array:
    """Which values pass; null never does."""
    kind = type(f)
    if kind is IsNotNull:
        return pc.is_valid(column)
    if kind is In:
        return pc.and_(pc.is_valid(column), pc.is_in(column, value_set=pa.array([v for v in f.value if v is not None], column.type)))
    test = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}[kind]
    return pc.fill_null(test(column, pa.scalar(f.value, column.type)), False)


def may_pass(f: Filter, low, high) -> bool:
    """Whether a run of values from low to high may hold one that passes."""
    kind = type(f)
    if kind is IsNotNull:
        return True
    if kind is In:
        return any(v is not None and low <= v <= high for v in f.value)
    return {EqualTo: lambda v: low <= v <= high, GreaterThan: lambda v: high > v, GreaterThanOrEqual: lambda v: high >= v, LessThan: lambda v: low < v, LessThanOrEqual: lambda v: low <= v}[kind](f.value)


@dataclass
class Run(InputPartition):
    system: str
    file: str
    groups: tuple[int, ...]


class CrmReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.object, self.names = options.get("object", "opportunities"), schema.names
        self.root, self.filters = options["path"], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = len(f.attribute) == 1 and f.attribute[0] in PUSHED & set(MAPS[self.object]) if hasattr(f, "attribute") else False
            if known and type(f) in (EqualTo, In, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                self.filters.append(f)
            else:
                yield f

    def of(self, column: str) -> list[Filter]:
        return [f for f in self.filters if f.attribute[0] == column]

    def files(self) -> tuple[pafs.FileSystem, list[str]]:
        where = f"{self.root.rstrip('/')}/{FILES[self.object][0]}"
        fs, path = pafs.FileSystem.from_uri(where) if "://" in where else (pafs.LocalFileSystem(), where.removeprefix("file:"))
        info = fs.get_file_info(path)
        if info.is_file:
            return fs, [path]
        found = fs.get_file_info(pafs.FileSelector(path))  # raises where there is none
        return fs, sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))

    def partitions(self) -> Sequence[InputPartition]:
        fs, paths = self.files()
        systems = [s for s in SYSTEMS if all(mask_of(f, pa.array([s]))[0].as_py() for f in self.of("source_system"))]
        out = []
        for path in paths:
            meta = pq.ParquetFile(path, filesystem=fs).metadata
            at = meta.schema.to_arrow_schema().names.index(FILES[self.object][1])
            runs, size = [[]], 0
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                if stats is not None and stats.has_min_max and not all(may_pass(f, stats.min, stats.max) for f in self.of("id")):
                    continue
                if runs[-1] and size + meta.row_group(g).total_byte_size > SPLIT:
                    runs.append([])
                    size = 0
                runs[-1].append(g)
                size += meta.row_group(g).total_byte_size
            out += [Run(s, path, tuple(r)) for r in runs if r for s in systems]
        return out or [Run("", "", ())]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.groups:
            return
        maps = MAPS[self.object]
        needed = list(dict.fromkeys([*self.names, "source_system", *(f.attribute[0] for f in self.filters)]))
        payload = sorted({c for n in needed for c in maps[n][0]})
        fs, _ = self.files()
        for b in pq.ParquetFile(partition.file, filesystem=fs).iter_batches(row_groups=list(partition.groups), columns=payload, batch_size=65536):
            made = {n: maps[n][1](*(b.column(c) for c in maps[n][0])) for n in needed}
            mask = pc.equal(made["source_system"], partition.system)
            for f in self.filters:
                mask = pc.and_(mask, mask_of(f, made[f.attribute[0]]))
            yield pa.RecordBatch.from_arrays([made[n].filter(mask) for n in self.names], names=self.names)


class CrmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crm"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("object", "opportunities")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return CrmReader(dict(self.options), schema)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source crm, filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CrmSource)
    return spark


class Adapter:
    """S-11: what one system lists, from the source crm."""

    def __init__(self, spark: SparkSession, path: str, system: str):
        if system not in SYSTEMS:
            raise ValueError(f"unknown system: {system}")
        self.spark, self.path, self.system = registered(spark), path, system

    def listed(self, object_: str) -> DataFrame:
        return self.spark.read.format("crm").option("path", self.path).option("object", object_).load().where(F.col("source_system") == self.system)

    def opportunities(self, stage: str | None = None) -> DataFrame:
        out = self.listed("opportunities")
        return out if stage is None else out.where(F.col("stage_canonical") == stage)

    def opportunity(self, id_: int) -> DataFrame:
        return self.opportunities().where(F.col("id") == id_)

    def campaigns(self) -> DataFrame:
        return self.listed("campaigns")

    def email_activity(self, campaign_id: int | None = None) -> DataFrame:
        out = self.listed("email_activity")
        return out if campaign_id is None else out.where(F.col("campaign_id") == campaign_id)
