"""Streaming forms: event counts in time windows, late rows dropped by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks need a timestamp with time zone; tables need no watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums per kind and window; works on streams and on tables."""
    d = _timed(events, time, late)
    return d.groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", user: str = "user_id") -> DataFrame:
    d = _timed(events, time, late)
    return d.groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), user, "n")
