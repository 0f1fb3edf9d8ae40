"""Feature columns of the history and of the future grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliodrift.functions.calendar import calendar_parts, cyclical_parts
from heliodrift.functions.measures import INTERACTION, interaction
from heliodrift.operators.columns import existing
from heliodrift.operators.sequences import lags_and_means
from heliodrift.schemas import ENTITY, HORIZON, LAGS, POWER, TIME, WEATHER

_PLACE = "__place"


def time_features(df: DataFrame, cyclical: bool = True) -> DataFrame:
    parts = calendar_parts()
    if cyclical:
        parts.update(cyclical_parts())
    if {"MODULE_TEMPERATURE", "IRRADIATION"} <= set(df.columns):
        parts[INTERACTION] = interaction()
    return df.withColumns(parts)


def history_features(
    history: DataFrame, by: Sequence[str] = ENTITY, **layout
) -> DataFrame:
    """Time features, and lags and means of weather and power, of a clean history."""
    columns = [c for c in WEATHER + POWER if c in history.columns]
    lagged = lags_and_means(history, columns, by, null_free=True, **layout)
    return time_features(lagged)


def future_features(
    future: DataFrame,
    by: Sequence[str] = ENTITY,
    history: DataFrame | None = None,
) -> DataFrame:
    """Features of a future grid with weather on it. Power lags are left out.

    The lags see the grid alone, so those that reach a whole horizon back are 0.
    With ``history`` the last rows of each series go first and the lags are real.
    """
    columns = existing(future, WEATHER)
    # A series of the grid has one row per step, at most 2 x HORIZON with history. Over all
    # series at once (``by=()``) rows go by the total order, and the split is counted.
    rest = [c for c in ENTITY if c not in by and c in future.columns]
    cell = "WHOLE" if by else None
    if history is None:
        lagged = lags_and_means(future, columns, by, (TIME, *rest), cell=cell)
        return time_features(lagged)
    before = _last_rows_of_each(history, by, max(max(LAGS), HORIZON))
    both = before.select(*by, *rest, TIME, *columns, _PLACE).unionByName(
        future.withColumn(_PLACE, F.lit(1)), allowMissingColumns=True
    )
    lagged = lags_and_means(both, columns, by, (TIME, _PLACE, *rest), cell=cell)
    return time_features(lagged.where(F.col(_PLACE) == 1).drop(_PLACE))


def _last_rows_of_each(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """The last rows of each series, placed 1 - rows to 0 in their order."""
    # A rank limit: each map task already keeps no more than ``rows`` per series.
    newest = Window.partitionBy(*by).orderBy(
        F.col(TIME).desc(), F.xxhash64(*df.columns).desc()
    )
    ranked = df.withColumn(_PLACE, F.row_number().over(newest))
    return ranked.where(F.col(_PLACE) <= rows).withColumn(_PLACE, 1 - F.col(_PLACE))
