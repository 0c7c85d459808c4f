"""Click rates in event-time windows, and session counts, over streams with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_clicks(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, n, ctr) of tumbling windows over ts and event_type; works on batches and streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "click").cast("double")).alias("ctr")).select(F.col("w.start").alias("start"), "n", "ctr")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events with no gap as long as ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
