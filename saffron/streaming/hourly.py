"""Hourly counts as a stream: an extension beside the batch panels.

Windows close once the watermark has passed their end, so late events count up to
the delay and each window is written once. State and progress live in the
checkpoint folder, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, folder: str, file_pattern: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder, under the schema of a table like them."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", file_pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hourly_counts(events: DataFrame, delay: str = "10 minutes", at: str = "ts", by: str = "event_type") -> DataFrame:
    """(by, hour, orders) of closed hours."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    counts = timed.withWatermark("_at", delay).groupBy(F.window("_at", "1 hour"), by).agg(F.count(F.lit(1)).alias("orders"))
    return counts.select(by, F.col("window.start").cast("timestamp_ntz").alias("hour"), "orders")


def write(counts: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append closed windows to Parquet; with ``available_now`` the query ends after what is there."""
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
