"""Live forms of the aggregate measures: watermarked windows over a stream of fixes (or a table of them)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visits_per_window(fixes: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Fixes of each window of datetime; rows later than the watermark are left out of a stream."""
    timed = fixes.withColumn("datetime", F.col("datetime").cast("timestamp")).withWatermark("datetime", late)
    return timed.groupBy(F.window("datetime", window).alias("w")).agg(F.count("*").alias("n_visits")).select(F.col("w.start").alias("time_unit"), "n_visits")


def sessions(fixes: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Runs of a user's fixes with at most gap between them: start, last fix plus gap, and their number."""
    timed = fixes.withColumn("datetime", F.col("datetime").cast("timestamp")).withWatermark("datetime", late)
    return timed.groupBy("uid", F.session_window("datetime", gap).alias("s")).agg(F.count("*").alias("n_fixes")).select("uid", F.col("s.start").alias("started_at"), F.col("s.end").alias("ended_at"), "n_fixes")
