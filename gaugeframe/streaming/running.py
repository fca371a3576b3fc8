"""Measurements over streams: the same aggregates, with event-time windows.

An extension: thickness, repeatability and deviation statistics decompose into
counts, sums and extremes, so they run unchanged over unbounded input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of its files; the schema is fixed."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days", low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Per window and event type: count, mean, sample deviation, range, counts outside limits."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    agg = out.groupBy(F.window("ts", width), "event_type").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean_v"), F.stddev_samp("value").alias("std_v"),
        (F.max("value") - F.min("value")).alias("range_v"), F.count_if(F.col("value") < low).alias("n_below"), F.count_if(F.col("value") > high).alias("n_above"),
    )
    return agg.select(F.col("window.start").alias("start"), "event_type", "n", "mean_v", "std_v", "range_v", "n_below", "n_above")


def running_repeatability(events: DataFrame, key: str = "event_type") -> DataFrame:
    """Unwindowed repeatability of each key, updated as values arrive."""
    return events.groupBy(key).agg(F.count("value").alias("n"), F.avg("value").alias("mean_v"), F.stddev_samp("value").alias("std_v"), (6 * F.stddev_samp("value")).alias("six_sigma"))
