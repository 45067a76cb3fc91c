"""Idempotent events as a stream (an extension; batch form: `operators.serve`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripforge.functions.scoring import event_id


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """events: a stream of request_id, place_key, action, at. Repeats within the delay are
    dropped; state older than that is forgotten."""
    rows = events.withColumn("event_id", event_id(F.col("request_id"), F.col("place_key"), F.col("action")))
    return rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def impressions(events: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events per action and window."""
    return events.withWatermark("at", delay).groupBy(F.window("at", window), "action").agg(F.count(F.lit(1)).alias("n"))
