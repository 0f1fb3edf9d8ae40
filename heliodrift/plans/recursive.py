"""Power forecast whose lags are the forecast itself: each block of steps feeds the next one.

A lag of four rows is known for four steps ahead, so the horizon is forecast in blocks of as many
steps as the shortest lag. Training and forecasting read the same features: the lags of a power
and the mean of the rows that end at the shortest lag, never the value that is to be predicted.

Each series is one row with its last values, as many as the longest lag reaches back, so a block is
a join of its grid rows with that row, a prediction, and a grouping of a few rows of each
series. It is written block by block: no plan holds more than one block, and a lost
executor costs one block at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliodrift.functions.calendar import CALENDAR_COLUMNS, CYCLICAL_COLUMNS
from heliodrift.functions.measures import INTERACTION
from heliodrift.operators.encode import fit_entity_encoder
from heliodrift.operators.profile import tail_per_series
from heliodrift.operators.sequences import lag_mean_names, lag_name, lags_and_means, mean_name
from heliodrift.operators.spine import STEP, entity_spine
from heliodrift.plans.features import future_features, history_features
from heliodrift.plans.forests import (
    LAG_PROFILE,
    ForestProfile,
    ModelSet,
    TargetModel,
    predict_chain,
    train_chain,
    training_frame,
)
from heliodrift.plans.persistence import FORECAST_COLUMNS, continue_yields, persistence_weather
from heliodrift.schemas import ENTITY, HORIZON, LAGS, MEAN_ROWS, ORDER, POWER, TIME, WEATHER
from heliodrift.session import shared_folder

_PAST = "__past_"


def lagged_mean_name(column: str, lag: int = min(LAGS), rows: int = MEAN_ROWS) -> str:
    return lag_name(mean_name(column, rows), lag)


def power_lag_names(column: str) -> list[str]:
    return [*(lag_name(column, n) for n in LAGS), lagged_mean_name(column)]


def with_lagged_means(
    df: DataFrame, columns: Sequence[str] = POWER, by: Sequence[str] = ENTITY, order: Sequence[str] = ORDER, **layout
) -> DataFrame:
    """Add the mean of the rows that end at the shortest lag, from the trailing means of ``df``."""
    means = [mean_name(c, MEAN_ROWS) for c in columns]
    lagged = lags_and_means(df, means, by, order, (min(LAGS),), 1, null_free=True, **layout)
    return lagged.drop(*[mean_name(c, 1) for c in means])


def recursive_features(dummies: Sequence[str]) -> dict[str, list[str]]:
    """Each power's features: time, keys, given weather, and lags that are known a block ahead."""
    base = [*CALENDAR_COLUMNS, *CYCLICAL_COLUMNS, *dummies, *WEATHER, INTERACTION, *lag_mean_names(WEATHER)]
    dc = [*base, *power_lag_names("DC_POWER")]
    return {"DC_POWER": dc, "AC_POWER": [*dc, "DC_POWER", *power_lag_names("AC_POWER")]}


def fit_recursive(
    history: DataFrame, profile: ForestProfile = LAG_PROFILE, cell: str | None = None, folder: str | None = None
) -> ModelSet:
    """Forests of both powers of a clean history, for :func:`forecast_recursive`."""
    frame = training_frame(with_lagged_means(history_features(history, cell=cell), cell=cell))
    encoder = fit_entity_encoder(frame)
    models = train_chain(encoder.transform(frame), recursive_features(encoder.names), profile, folder)
    return ModelSet("recursive", models, encoder)


def last_values(history: DataFrame, columns: Sequence[str] = POWER, by: Sequence[str] = ENTITY) -> DataFrame:
    """One row for each series: the arrays of its last values, as far back as the longest lag."""
    order = [c for c in ORDER if c not in by]
    recent = tail_per_series(history.select(*by, *order, *columns), max(LAGS), by)
    rows = F.sort_array(F.collect_list(F.struct(*order, *columns)))
    table = recent.groupBy(*by).agg(rows.alias("__rows"))
    return table.select(*by, *[F.col(f"__rows.{c}").alias(f"{_PAST}{c}") for c in columns])


def _lags(column: str, place: Column) -> dict[str, Column]:
    """Lags of a step at ``place`` (0 for the first one) behind the values of the array.

    Where a lag reaches back behind the series, its first value stands in, as in training.
    """
    past = F.col(f"{_PAST}{column}")
    at = F.size(past) + place
    found = {lag_name(column, n): F.get(past, F.greatest(at - n, F.lit(0)).cast("int")) for n in LAGS}
    last = F.greatest(at - min(LAGS), F.lit(0))
    first = F.greatest(last - (MEAN_ROWS - 1), F.lit(0))
    window = F.slice(past, (first + 1).cast("int"), (last - first + 1).cast("int"))
    total = F.aggregate(window, F.lit(0.0), lambda a, x: a + x)
    return {**found, lagged_mean_name(column): total / F.size(window)}


def predict_blocks(
    future: DataFrame,
    past: DataFrame,
    models: dict[str, TargetModel],
    columns: Sequence[str] = POWER,
    by: Sequence[str] = ENTITY,
    periods: int = HORIZON,
) -> DataFrame:
    """``future`` with ``columns`` predicted in order, block by block.

    ``future`` has a row for each series and step, with all features but the lags of ``columns``;
    ``past`` is that of :func:`last_values`. A column without a model is 0.
    """
    shared_folder(future.sparkSession)
    future = future.checkpoint()
    block, reach = min(LAGS), max(LAGS)
    done: list[DataFrame] = []
    for start in range(0, periods, block):
        rows = future.where((F.col(STEP) >= start) & (F.col(STEP) < start + block)).join(past, list(by))
        lags = {k: v for c in columns for k, v in _lags(c, F.col(STEP) - start).items()}
        found = predict_chain(rows.withColumns(lags), models, columns).checkpoint()
        done.append(found.drop(*[f"{_PAST}{c}" for c in columns]))
        steps = F.sort_array(F.collect_list(F.struct(STEP, *columns)))
        grouped = found.groupBy(*by).agg(
            steps.alias("__new"), *[F.any_value(f"{_PAST}{c}").alias(f"{_PAST}{c}") for c in columns]
        )
        past = grouped.select(
            *by,
            *[
                _last(F.concat(F.col(f"{_PAST}{c}"), F.col(f"__new.{c}")), reach).alias(f"{_PAST}{c}")
                for c in columns
            ],
        )
    return reduce(DataFrame.unionByName, done)


def _last(values: Column, count: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - count + 1, F.lit(1)), F.lit(count))


def forecast_recursive(
    history: DataFrame,
    fitted: ModelSet,
    future_weather: DataFrame | None = None,
    entities: str = "all",
) -> DataFrame:
    """Forecast power from given or persisted weather, each block on the blocks before, then yields."""
    if future_weather is None:
        future = persistence_weather(history, WEATHER, entities)
    else:
        spine = entity_spine(history, ENTITY, entities)
        future = spine.join(future_weather.select(TIME, *WEATHER), TIME, "left")
    ready = fitted.encoder.transform(future_features(future, history=history))
    forecast = predict_blocks(ready, last_values(history), fitted.models)
    return continue_yields(forecast, history, entities).select(*FORECAST_COLUMNS)


def recursive_forecast(
    history: DataFrame,
    profile: ForestProfile = LAG_PROFILE,
    future_weather: DataFrame | None = None,
    entities: str = "all",
    cell: str | None = None,
) -> DataFrame:
    """Fit on a clean history and forecast from its end."""
    shared_folder(history.sparkSession)
    history = history.checkpoint()
    return forecast_recursive(history, fit_recursive(history, profile, cell), future_weather, entities)
