"""Calendar parts of an epoch-seconds column in an explicit time zone.

The epoch value is turned into a wall-clock ``TIMESTAMP_NTZ`` in UTC and then
converted to the requested zone, so the result never depends on the
session time zone (the original job used the host's zone implicitly).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400


def local_wall_clock(epoch_seconds: Column, tz: str = "UTC") -> Column:
    utc = F.timestamp_add("SECOND", epoch_seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    if tz == "UTC":
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def period_of_day(hour: Column) -> Column:
    """01-06h -> 0, 07-12h -> 1, 13-18h -> 2, otherwise (19-00h) -> 3."""
    return (F.when((hour >= 1) & (hour < 7), 0)
            .when((hour >= 7) & (hour < 13), 1)
            .when((hour >= 13) & (hour < 19), 2)
            .otherwise(3))


def time_parts(epoch_seconds: Column, tz: str = "UTC", prefix: str = "action_time") -> list[Column]:
    """month, day, hour, ISO weekday (Mon=1), period of day and weekend flag."""
    local = local_wall_clock(epoch_seconds, tz)
    hour = F.hour(local)
    dow = F.weekday(local) + 1
    return [
        F.month(local).alias(f"{prefix}_month"),
        F.dayofmonth(local).alias(f"{prefix}_day"),
        hour.alias(f"{prefix}_hour"),
        dow.alias(f"{prefix}_dayOfWeek"),
        period_of_day(hour).alias(f"{prefix}_periodOfDay"),
        F.when(dow.isin(6, 7), 1).otherwise(0).alias(f"{prefix}_isWeekend"),
    ]


def to_days(epoch_seconds: Column) -> Column:
    """Epoch seconds -> fractional days."""
    return epoch_seconds / F.lit(float(SECONDS_PER_DAY))
