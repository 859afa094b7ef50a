"""Streaming counterparts of the temporal aggregation, over a folder of event files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_cells(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """(start, x, y, n, total) of each window and cell; rows later than `late` go."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    cell = kept.groupBy(w, (F.col("user_id") % 16).alias("x"), F.expr("user_id div 16").alias("y"))
    return cell.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "x", "y", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a pause of `gap`."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    found = kept.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_once(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the files there are now, as a table in memory (for tests and small results)."""
    name = f"stream_{uuid.uuid4().hex}"
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
