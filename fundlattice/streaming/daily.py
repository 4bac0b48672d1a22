"""Streams: daily series from events, and fresh estimates over slow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_series(events: DataFrame, late: str = "1 day") -> DataFrame:
    """STR-4: counts and sums of values by type and day; works on streams (with a watermark) and on tables."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select("event_type", F.to_date("w.start").alias("d"), "n", "cents")


def estimate_override(estimates: DataFrame, navs: DataFrame) -> DataFrame:
    """STR-1, FLT-12: the estimate where its day is later than the last official value's, else that value.

    estimates may be a stream; navs (code, data_end, unit_nav) is the slow side, joined by code.
    """
    fresh = F.try_to_date(F.left("estimate_time", F.lit(10))) > F.col("data_end")
    return estimates.join(navs, "code", "left").select("code", "estimate_time", "data_end", F.coalesce(fresh, F.lit(False)).alias("fresh"), F.when(F.coalesce(fresh, F.lit(False)), F.col("estimated_nav")).otherwise(F.col("unit_nav")).alias("nav"))


def delay_days(navs: DataFrame, as_of) -> DataFrame:
    """IND-25, STR-3: days by which each code's last value lags as_of; a note from two days on."""
    days = F.datediff(F.lit(as_of).cast("date"), F.col("data_end"))
    return navs.select("code", "data_end", days.alias("days_behind"), (days >= 2).alias("delayed"))
