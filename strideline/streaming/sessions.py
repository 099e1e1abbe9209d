"""Sessions of events; the same plan for a table and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """user_id, start, n, total of each run of a user's events with less than gap between neighbours.

    On a stream events later than `late` are dropped by the watermark, and state is kept for open sessions alone.
    Events without a time belong to no session.
    """
    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value").where("ts is not null")
    e = e.withWatermark("ts", late) if events.isStreaming else e
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")
