"""An extension for ledgers that arrive as streams: counts in windows of event time, simultaneous postings, repeated lines.

Late rows are accepted up to the watermark; each function takes a streaming frame and gives one, to be written in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(stream: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), *keys, "n")


def trailing_counts(stream: DataFrame, at: str, keys: list[str], days: int = 7, late: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, f"{days} days", "1 day"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("until"), *keys, "n")


def simultaneous(stream: DataFrame, at: str, least: int, late: str = "1 hour") -> DataFrame:
    """Seconds in which at least so many rows arrive."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 second")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(F.col("window.start").alias("at"), "n")


def sessions(stream: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of a user: rows no further apart than the gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("session_window.start").alias("since"), F.col("session_window.end").alias("until"), "n")


def without_repeats(stream: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first of equal rows within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
