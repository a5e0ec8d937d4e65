"""Streaming forms of the weekly counts and of the refresh (extras: the data model has batches only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_counts(events: DataFrame, late: str = "33 hours") -> DataFrame:
    """ST-1, ST-2: counts by Monday week and type; a week closes at Monday 09:00 of the second day after it.

    events: ts, event_type. Rows later than the watermark are dropped by Spark.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    week = F.window("ts", "7 days", "7 days", "4 days")
    return timed.groupBy(week.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("week"), "event_type", "n")


def refresh_into(stream: DataFrame, path: str, checkpoint: str, keys: list[str], version: str):
    """ST-3: each micro-batch's latest row per key is appended as its own folder; a batch that is run again replaces its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")
        last.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key over all batches."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "epoch")).alias("r")).select(*keys, "r.*")
