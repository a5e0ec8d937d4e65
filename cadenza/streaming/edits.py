"""ST-2: edits of weeks as a stream in which no row is lost: each is accepted, or rejected for a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import exprs as X


def judged(edits: DataFrame, overrides: DataFrame) -> DataFrame:
    """edits (edit_id, period_start, at) with `reason`: null where the week is open when it is edited or has an override, else locked."""
    open_ = overrides.select("period_start").distinct().withColumn("__open", F.lit(True))
    locked = X.week_locked(F.col("period_start"), F.col("at")) & F.col("__open").isNull()
    return edits.join(open_, "period_start", "left").withColumn("reason", F.when(locked, "locked")).drop("__open")


def first_of_each(df: DataFrame) -> DataFrame:
    """Of the rows of one edit_id the earliest keeps its reason; the others are duplicates. Rows without an id are edits of their own."""
    place = F.row_number().over(Window.partitionBy("edit_id").orderBy("at", "period_start"))
    return df.withColumn("__place", place).withColumn("reason", F.when((F.col("__place") > 1) & F.col("edit_id").isNotNull(), "duplicate").otherwise(F.col("reason"))).drop("__place")


def edits_into(stream: DataFrame, overrides: DataFrame, path: str, checkpoint: str, horizon: str = "33 hours") -> StreamingQuery:
    """Each micro-batch is judged against the overrides as they are then, and appended under path/epoch=n with its reasons.

    A retry of an edit within `horizon` of the newest edit seen is a duplicate, and what is older than that is late: instead of
    being dropped behind a watermark, both are kept with that reason. Earlier epochs are the memory (those rows whose time is in the horizon),
    so a restart knows what was seen, and an epoch that runs again replaces its own folder.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        out = first_of_each(judged(batch, overrides))
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if epoch and hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
            seen = spark.read.schema(out.withColumn("epoch", F.lit(0)).schema).parquet(path).where(F.col("epoch") < epoch)
            newest = seen.agg(F.max("at")).first()[0]
            edge = F.lit(newest) - F.expr(f"INTERVAL {horizon}")
            known = seen.where(F.col("at") >= edge).select("edit_id").distinct().withColumn("__known", F.lit(True))
            out = out.join(known, "edit_id", "left")
            out = out.withColumn("reason", F.when(F.col("at") < edge, "late").when(F.col("__known"), "duplicate").otherwise(F.col("reason"))).drop("__known")
        out.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
