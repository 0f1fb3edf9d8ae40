"""Energy counters that continue the history over a forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliodrift.functions.calendar import day
from heliodrift.functions.measures import energy, zero_if_null
from heliodrift.schemas import (
    DAILY_FORECAST,
    ENTITY,
    STEP_MINUTES,
    TIME,
    TOTAL_FORECAST,
)


def add_yields(
    forecast: DataFrame,
    total_seed: Column,
    daily_seed: Column,
    last_time: Column,
    by: Sequence[str] = ENTITY,
    step_minutes: int = STEP_MINUTES,
    power: str = "AC_POWER",
) -> DataFrame:
    """Add the forecast's lifetime and daily energy counters.

    The lifetime counter goes on from ``total_seed``. The daily one restarts at
    midnight and goes on from ``daily_seed`` only on a first forecast day that is
    also the day of ``last_time``. Without a power column both are 0.

    A forecast has one row per series and step of the horizon, so these windows are
    bounded by the horizon and need no segments.
    """
    if power not in forecast.columns:
        return forecast.withColumns(
            {TOTAL_FORECAST: F.lit(0.0), DAILY_FORECAST: F.lit(0.0)}
        )
    upto = (Window.unboundedPreceding, Window.currentRow)
    series = Window.partitionBy(*by).orderBy(TIME)
    days = Window.partitionBy(*by, day()).orderBy(TIME)
    used = F.sum(energy(power, step_minutes))
    first_day = F.to_date(F.first(TIME).over(series))
    carried = F.when(
        (day() == first_day) & (F.to_date(last_time) == first_day),
        zero_if_null(daily_seed),
    ).otherwise(F.lit(0.0))
    return forecast.withColumns(
        {
            TOTAL_FORECAST: zero_if_null(total_seed)
            + used.over(series.rowsBetween(*upto)),
            DAILY_FORECAST: carried + used.over(days.rowsBetween(*upto)),
        }
    )
