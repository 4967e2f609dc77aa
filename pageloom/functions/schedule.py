"""Time and number helpers of the job table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import fixed_values as V


def numeric_urgency(value: Column) -> Column:
    """Number, with bad or missing values read as 0."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def to_ts(value: Column) -> Column:
    """Zone-less timestamp, null when the text is not one."""
    return value.cast("string").try_cast("timestamp_ntz")


def elapsed_seconds(last: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", last, now)


def is_due(last: Column, interval_seconds: Column, now: Column) -> Column:
    return last.isNull() | (elapsed_seconds(last, now) >= interval_seconds)


def shrink_interval(current: Column) -> Column:
    return F.greatest(F.lit(V.MIN_INTERVAL), (current * F.lit(V.SHRINK)).cast("int")).cast("int")


def adjust_interval(current: Column, urgency: Column, has_new: Column) -> Column:
    """Next interval: short after urgent news, a little shorter after other news, longer after none.

    News without an urgency (null or 0) leaves the interval as it is.
    """
    grown = F.least(F.lit(V.MAX_INTERVAL), (current * F.lit(V.GROW)).cast("bigint")).cast("int")
    return (
        F.when(~has_new, grown)
        .when(F.coalesce(urgency, F.lit(0)) == 0, current)
        .when(urgency >= V.HOT_URGENCY, F.lit(V.HOT_INTERVAL))
        .when(urgency >= V.WARM_URGENCY, F.lit(V.WARM_INTERVAL))
        .otherwise(shrink_interval(current))
    )
