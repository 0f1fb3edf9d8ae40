"""From files, or a history and an optional weather file, to a forecast in one call."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from heliodrift.operators.combine import join_weather
from heliodrift.operators.spine import future_spine
from heliodrift.plans.clean import clean
from heliodrift.plans.forests import LAG_PROFILE, ForestProfile, lag_forecast
from heliodrift.schemas import ENTITY
from heliodrift.sources.csv_files import read_generation, read_weather
from heliodrift.sources.future_weather import load_future_weather


class Forecast(NamedTuple):
    frame: DataFrame
    weather_reason: str


def history_from_files(
    spark: SparkSession,
    generation: str | Sequence[str],
    weather: str | Sequence[str],
    by: Sequence[str] = ENTITY,
    include_time: bool = True,
) -> DataFrame:
    """Clean history of generation and weather files; no row left raises.

    ``by=(), include_time=False`` drops rows that repeat but for their time and fills over
    all series at once.
    """
    joined = join_weather(
        read_generation(spark, generation, raw=True), read_weather(spark, weather, raw=True)
    )
    return clean(joined, by, include_time, guard=True)


def forecast_with_weather(
    history: DataFrame,
    path: str | None = None,
    profile: ForestProfile = LAG_PROFILE,
    entities: str = "all",
) -> Forecast:
    """Forecast by two forests on the weather of ``path``; without a usable file it is persisted.

    ``weather_reason`` says where the weather came from.
    """
    found = load_future_weather(history.sparkSession, future_spine(history), path)
    return Forecast(lag_forecast(history, found.frame, profile, entities), found.reason)
