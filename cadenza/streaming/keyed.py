"""Rules over each key's hits in time order: rolling rate limits and sessions that expire, as batches and as streams (extras).

A batch sorts by key and time and folds over Arrow batches with the state of one key, so that no
group is held whole; one key's hits are one task's, since each verdict depends on the one before.
The streams keep the same state by key and let event-time timers clear or emit it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need this package on no path

#: Five hits an hour, sessions of seven days; in microseconds.
MOST, WINDOW, TTL = 5, 3_600_000_000, 7 * 86_400_000_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Keyed state of this kind needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def let_through(times: np.ndarray, held: list[int], most: int, window: int) -> tuple[np.ndarray, list[int]]:
    """Which of one key's hits, in time order, are let through, and the times that count from there on.

    Only hits that were let through fill the window, so a rejected one never delays the next. Runs of
    rejected hits are passed over in one step, to the first hit at which the oldest counted one has left.
    """
    out, i = np.zeros(len(times), bool), 0
    while i < len(times):
        held = [t for t in held if times[i] - t < window]
        if len(held) < most:
            out[i] = True
            held.append(int(times[i]))
            i += 1
        else:
            i = max(i + 1, int(np.searchsorted(times, min(held) + window, "left")))
    return out, held


def rate_limit(hits: DataFrame, key: str, at: str, order: str, most: int = MOST, window: int = WINDOW) -> DataFrame:
    """ST-4: hits with `admitted`. at: microseconds, not null; ties go by `order`. Null keys are one key. A column named admitted is replaced."""
    rows = hits.select(*(c for c in hits.columns if c.lower() != "admitted"))
    schema = T.StructType([*rows.schema.fields, T.StructField("admitted", T.BooleanType())])
    k, a = rows.columns.index(key), rows.columns.index(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), b.num_rows]
            times, out = b.column(a).to_numpy(), np.zeros(b.num_rows, bool)
            for first, end in zip(edges, edges[1:], strict=False):
                now = b.column(k)[first].as_py()
                if held is None or now != last:
                    last, held = now, []
                out[first:end], held = let_through(times[first:end], held, most, window)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=schema.names)

    return rows.repartition(key).sortWithinPartitions(key, at, order).mapInArrow(run, schema)


class Limiter(StatefulProcessor):
    """The times that count of each key; a timer drops them once none can."""

    def __init__(self, most: int, window: int):
        self.most, self.window = most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hits = pd.concat(list(rows)).sort_values(["at", "event_id"])
        before = [r[0] for r in self.held.get()] if self.held.exists() else []
        mask, held = let_through(hits["at"].to_numpy(), before, self.most, self.window)
        self.held.put([(t,) for t in held])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((max(held) + self.window) // 1000 + 1)
        yield hits[["event_id", "client", "at"]].assign(admitted=mask)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])


def rate_limit_stream(hits: DataFrame, delay: str = "0 seconds", most: int = MOST, window: int = WINDOW) -> DataFrame:
    """ST-4 as a stream of event_id, client, at and ts: the batch's verdicts, where hits come in time order. The state of a key is at most `most` times."""
    return hits.withWatermark("ts", delay).groupBy("client").transformWithStateInPandas(Limiter(most, window), "event_id bigint, client bigint, at bigint, admitted boolean", "Append", "EventTime")


# --- sessions ------------------------------------------------------------------------------


def sessions(touches: DataFrame, key: str, at: str, ttl: int = TTL) -> DataFrame:
    """ST-5: key, started_at, expired_at and touches of each session: a touch moves its end to `ttl` later; one beyond the end begins another."""
    w = Window.partitionBy(key).orderBy(at)
    begins = F.coalesce(F.col(at) > F.lag(at).over(w) + ttl, F.lit(True))
    numbered = touches.withColumn("__begins", begins.cast("int")).withColumn("__n", F.sum("__begins").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "__n").agg(F.min(at).alias("started_at"), (F.max(at) + ttl).alias("expired_at"), F.count(F.lit(1)).alias("touches")).drop("__n")


def session_stream(touches: DataFrame, delay_ms: int = 0, ttl: int = TTL) -> DataFrame:
    """ST-5 as a stream of sid and at: each session once, when the watermark passes its end.

    Spark's session windows keep its start, end and touches in the state; no key calls Python. They take a touch at the very end
    in and end once the watermark is there. A session with such an end is still open, so time runs doubled and ends half a microsecond later.
    """
    twice = touches.select("sid", "at", F.timestamp_micros(2 * F.col("at")).alias("twice")).withWatermark("twice", f"{2 * delay_ms} milliseconds")
    by = twice.groupBy("sid", F.session_window("twice", f"{2 * ttl + 1} microseconds").alias("open"))
    by = by.agg(F.min("at").alias("started_at"), (F.max("at") + ttl).alias("expired_at"), F.count(F.lit(1)).alias("touches"))
    return by.select("sid", "started_at", "expired_at", "touches")
