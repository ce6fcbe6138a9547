"""Streams: new documents update term statistics as partial sums, and events are counted in windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators.stats import merge_bins, score_bins


def bins_sink(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of (year, term, score) adds its partial bins under its own number, so that a repeated batch replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        score_bins(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scores.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_bins(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """Weighted means and bins over all batches so far."""
    return merge_bins(spark.read.parquet(path).drop("batch"), least)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of (ts, event_type) in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events without a pause of ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
