"""Streaming forms of session and bucket summaries: extensions, as batch input is the rule here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour", user_col: str = "user_id", time_col: str = "ts") -> DataFrame:
    """user, start, end, events of each session; a session is closed once the watermark has passed its end."""
    return events.withWatermark(time_col, late).groupBy(F.col(user_col).alias("user"), F.session_window(time_col, gap).alias("w")).agg(F.count("*").alias("events")).select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def buckets(events: DataFrame, *, width: str = "1 hour", late: str = "1 hour", type_col: str = "event_type", time_col: str = "ts", value_col: str = "value") -> DataFrame:
    """Count and mean per window and type."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), F.col(type_col).alias("type")).agg(F.count("*").alias("n"), F.avg(value_col).alias("mean")).select(F.col("w.start").alias("start"), "type", "n", "mean")


def without_repeats(events: DataFrame, *, key: str = "event_id", late: str = "1 hour", time_col: str = "ts") -> DataFrame:
    """Each key once, as long as repeats come within the watermark."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])
