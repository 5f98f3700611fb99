"""Structured Streaming forms of the prediction log, live figures, drift and de-duplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..sources.star_schema import TABLES


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a file stream with event time."""
    return (
        spark.readStream.schema(TABLES["events"]).option("pathGlobFilter", "events.parquet")
        .parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    )


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append all available input to Parquet (exactly once through the file sink's log)."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def batch_folder(out: str, prepare: Callable[[DataFrame], DataFrame]):
    """Writer that owns one folder per batch, so that a repeated batch replaces its rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch():
            prepare(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


def last_folder(out: str, prepare: Callable[[DataFrame], DataFrame]):
    """Writer for complete mode: what the last batch gives replaces what earlier ones gave."""
    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch():
            prepare(batch).write.mode("overwrite").parquet(out)

    return write


def day_folders(out: str, day: str = "day"):
    """Writer for update mode: the days of a batch replace the same days of earlier batches.

    A batch must hold all rows of a day, as figures of whole windows do.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            day).parquet(out)

    return write


def kpi_windows(events: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Live counts per day and type; in append mode a window is emitted once it is closed."""
    return events.withWatermark("ts", delay).groupBy(
        F.window("ts", width).alias("w"), "event_type"
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"),
          F.count_if(F.col("value") >= 100).alias("n_large")).select(
        F.to_date("w.start").alias("day"), "event_type", "n", "total", "n_large")


def dedup(events: DataFrame, keys: list[str], delay: str = "40 days") -> DataFrame:
    """Drop repeated ids that arrive within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
