"""Future time grids and what the last reading of each series puts on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliodrift.functions.calendar import shift_minutes
from heliodrift.operators.profile import last_rows
from heliodrift.schemas import ENTITY, HORIZON, ORDER, STEP_MINUTES, TIME

STEP = "step"


def spine_start(history: DataFrame, step_minutes: int = STEP_MINUTES) -> Column:
    """One step after the latest reading of the whole table."""
    return history.select(shift_minutes(F.max(TIME), step_minutes)).scalar()


def spine_times(
    start: Column, periods: int = HORIZON, step_minutes: int = STEP_MINUTES
) -> Column:
    """An array of ``periods`` regular timestamps."""
    end = shift_minutes(start, step_minutes * (periods - 1))
    return F.sequence(start, end, F.expr(f"INTERVAL '{step_minutes}' MINUTE"))


def future_spine(
    history: DataFrame, periods: int = HORIZON, step_minutes: int = STEP_MINUTES
) -> DataFrame:
    """The regular timestamps that follow the history, numbered from 0."""
    start = history.agg(shift_minutes(F.max(TIME), step_minutes).alias("start"))
    times = spine_times(F.col("start"), periods, step_minutes)
    return start.where("start is not null").select(F.posexplode(times).alias(STEP, TIME))


def entity_spine(
    history: DataFrame,
    by: Sequence[str] = ENTITY,
    entities: str = "all",
    periods: int = HORIZON,
    step_minutes: int = STEP_MINUTES,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """The future grid of each series, with its last reading on every row.

    All series share one grid, which starts after the latest reading of the table.
    Columns of the last reading other than ``by`` get the prefix ``last_``.
    ``entities='last'`` keeps only the series of the very last row.
    """
    if entities not in ("all", "last"):
        raise ValueError(f"entities must be 'all' or 'last', not {entities!r}")
    last = last_rows(history, by if entities == "all" else (), order)
    times = spine_times(spine_start(history, step_minutes), periods, step_minutes)
    return last.select(
        *by,
        *[F.col(c).alias(f"last_{c}") for c in last.columns if c not in by],
        F.posexplode(times).alias(STEP, TIME),
    )
