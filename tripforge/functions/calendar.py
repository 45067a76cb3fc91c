"""Periods of the day, classes of day, time splits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PERIODS = ("morning", "lunch", "afternoon", "dinner", "night")
WEEKDAY_CLASSES = ("weekday", "weekend")
TRAIN_UNTIL = "2026-03-16 00:00:00"
VALIDATION_UNTIL = "2026-04-01 00:00:00"


def period_of_hour(hour: Column) -> Column:
    """The period that the data pipeline uses: hours 0 to 4 are night."""
    return F.when(hour.between(5, 10), "morning").when(hour.between(11, 13), "lunch").when(hour.between(14, 16), "afternoon").when(hour.between(17, 20), "dinner").otherwise("night")


def serving_period_of_hour(hour: Column) -> Column:
    """The period that requests use: hours 0 to 4 are morning."""
    return F.when(hour < 11, "morning").otherwise(period_of_hour(hour))


def weekday_class(at: Column) -> Column:
    return F.when(F.weekday(at) < 5, "weekday").otherwise("weekend")


def split_of(at: Column) -> Column:
    """at: an instant; the cut-offs are in the session's time zone."""
    return F.when(at < F.to_timestamp(F.lit(TRAIN_UNTIL)), "train").when(at < F.to_timestamp(F.lit(VALIDATION_UNTIL)), "validation").otherwise("test")


def context_key(period: Column, day: Column) -> Column:
    return F.concat_ws("|", period, day)
