"""Extra: training logs as streams of Parquet files (the reference has no event time; these are additions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def window_means(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, metric, n, mean per window; a window is final once the watermark has passed it."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), F.col("event_type").alias("metric"), "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of each user's sessions."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def totals(events: DataFrame) -> DataFrame:
    """metric, n, total: running over the whole stream, for the complete or update mode."""
    return events.groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


def run(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes all that is there by now as Parquet and stops; a later run goes on from the checkpoint."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
