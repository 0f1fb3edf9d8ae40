"""The forecast without a model: values of one day earlier, and their energy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodrift.operators.nearest import persist_last, persist_nearest
from heliodrift.operators.profile import first_at_latest
from heliodrift.operators.yields import add_yields
from heliodrift.schemas import (
    DAILY_FORECAST,
    ENTITY,
    PLANT,
    POWER,
    SOURCE,
    TIME,
    TOTAL_FORECAST,
    WEATHER,
)

FORECAST_COLUMNS = (
    TIME,
    PLANT,
    SOURCE,
    *WEATHER,
    *POWER,
    DAILY_FORECAST,
    TOTAL_FORECAST,
)


def persistence_weather(
    history: DataFrame,
    columns: Sequence[str] = WEATHER,
    entities: str = "all",
    mode: str = "nearest",
    by: Sequence[str] = ENTITY,
) -> DataFrame:
    """Future grid with ``columns`` persisted; columns the history lacks are 0.

    ``mode='last'`` repeats the last reading instead of looking a day back.
    """
    present = [c for c in columns if c in history.columns]
    persist = {"nearest": persist_nearest, "last": persist_last}[mode]
    future = persist(history, present, by, entities)
    absent = [c for c in columns if c not in present]
    return future.withColumns({c: F.lit(0.0) for c in absent}) if absent else future


def continue_yields(
    forecast: DataFrame, history: DataFrame, entities: str = "all"
) -> DataFrame:
    """Add the yields, seeded by the history's counters.

    Each series goes on from its own last row. With ``entities='last'`` the lifetime
    counter goes on from the last row of the table and the daily one from the first
    row at the latest time.
    """
    daily = F.col("last_DAILY_YIELD")
    if entities == "last":
        daily = first_at_latest(history).select("DAILY_YIELD").scalar()
    return add_yields(
        forecast, F.col("last_TOTAL_YIELD"), daily, F.col(f"last_{TIME}")
    )


def persistence_forecast(
    history: DataFrame,
    entities: str = "all",
    mode: str = "nearest",
    persist_power: bool = True,
) -> DataFrame:
    """Weather, power and yields of the next day for each series of a clean history.

    ``persist_power=False`` sets both powers to 0, as when no model exists.
    """
    columns = WEATHER + POWER if persist_power else WEATHER
    future = persistence_weather(history, columns, entities, mode)
    if not persist_power:
        future = future.withColumns({c: F.lit(0.0) for c in POWER})
    return continue_yields(future, history, entities).select(*FORECAST_COLUMNS)
