"""Calendar and cyclical features of a naive timestamp column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliodrift.schemas import TIME

CALENDAR_COLUMNS = ("hour", "minute", "dayofweek", "dayofyear", "month")
CYCLICAL_COLUMNS = ("timeofday_sin", "timeofday_cos", "dayofyear_sin", "dayofyear_cos")

_MINUTES_PER_DAY = 24 * 60
# A fixed 365.0, also in leap years, so 31 December of one is slightly past the turn.
_DAYS_PER_YEAR = 365.0


def time_of_day(time: str = TIME) -> Column:
    return F.date_format(time, "HH:mm:ss")


def day(time: str = TIME) -> Column:
    return F.to_date(time)


def calendar_parts(time: str = TIME) -> dict[str, Column]:
    """Hour, minute, weekday with Monday as 0, day of year and month."""
    return {
        "hour": F.hour(time),
        "minute": F.minute(time),
        "dayofweek": F.weekday(time),
        "dayofyear": F.dayofyear(time),
        "month": F.month(time),
    }


def cyclical_parts(time: str = TIME) -> dict[str, Column]:
    """Time of day and day of year as points on the unit circle."""
    minute_angle = (F.hour(time) * 60 + F.minute(time)) * (
        2 * math.pi / _MINUTES_PER_DAY
    )
    day_angle = F.dayofyear(time) * (2 * math.pi / _DAYS_PER_YEAR)
    return {
        "timeofday_sin": F.sin(minute_angle),
        "timeofday_cos": F.cos(minute_angle),
        "dayofyear_sin": F.sin(day_angle),
        "dayofyear_cos": F.cos(day_angle),
    }


def shift_minutes(time: Column | str, minutes: int) -> Column:
    """Move a naive timestamp by whole minutes without a time zone."""
    time = F.col(time) if isinstance(time, str) else time
    return time + F.expr(f"INTERVAL '{minutes}' MINUTE")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact seconds, with microseconds, from one naive timestamp to another.

    Subtracting gives a day-time interval; ``timestampdiff`` would go through the
    session time zone and be an hour off over a clock change.
    """
    return (later - earlier).cast("interval second").cast("decimal(18,6)")
