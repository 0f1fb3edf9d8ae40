"""Result frames: history next to forecast, and the daily comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodrift.operators.columns import strip_forecast_suffix
from heliodrift.operators.profile import tail, tail_per_series
from heliodrift.schemas import (
    DAILY_FORECAST,
    ENTITY,
    HORIZON,
    ORDER,
    POWER,
    TIME,
    TOTAL_FORECAST,
    WEATHER,
)

CHAIN_CONTEXT_ROWS = 3 * HORIZON
LAG_CONTEXT_ROWS = 2 * HORIZON
SERIES = WEATHER + POWER + (DAILY_FORECAST, TOTAL_FORECAST)


def forecast_output(forecast: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All forecast rows in order, with those of the columns that exist."""
    keys = [c for c in ORDER if c in forecast.columns]
    wanted = [c for c in columns if c in forecast.columns and c not in keys]
    return forecast.select(*keys, *wanted).orderBy(*keys)


def long_frame(
    history: DataFrame,
    forecast: DataFrame,
    context_rows: int = CHAIN_CONTEXT_ROWS,
    provided: Sequence[str] = (),
    series: Sequence[str] = SERIES,
    by: Sequence[str] = ENTITY,
) -> DataFrame:
    """One row per time and series: recent history, then the forecast, labelled.

    ``context_rows`` are those of each source; ``by=()`` takes them from all sources at once.

    Labels: Historical; User-Provided for the ``provided`` weather; Derived for the
    yields when weather was provided; else Forecasted.
    """
    keys = [TIME, *ENTITY]
    shown = [c for c in series if c in forecast.columns]
    continued = [
        c for c in dict.fromkeys(map(strip_forecast_suffix, shown)) if c in history.columns
    ]
    shown_history = history.select(*keys, *continued)
    recent = (
        tail_per_series(shown_history, context_rows, by) if by else tail(shown_history, context_rows)
    )
    past = (
        recent.unpivot(keys, continued, "series", "value")
        .withColumn("label", F.lit("Historical"))
    )
    name = F.col("series")
    label = F.lit("Forecasted")
    if provided:
        label = (
            F.when(name.isin(*provided), "User-Provided")
            .when(name.isin(DAILY_FORECAST, TOTAL_FORECAST), "Derived")
            .otherwise(label)
        )
    ahead = (
        forecast.select(*keys, *shown)
        .unpivot(keys, shown, "series", "value")
        .withColumn("label", label)
        .withColumn("series", F.regexp_replace("series", "_forecasted$", ""))
    )
    return past.unionByName(ahead)
