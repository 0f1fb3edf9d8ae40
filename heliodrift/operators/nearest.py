"""As-of lookups: the reading nearest to each future time, one day earlier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliodrift.functions.calendar import seconds_between, shift_minutes
from heliodrift.operators.spine import STEP, entity_spine, spine_start
from heliodrift.schemas import ENTITY, HORIZON, ORDER, STEP_MINUTES, TIME

DAY_MINUTES = 24 * 60


def persist_nearest(
    history: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ENTITY,
    entities: str = "all",
    periods: int = HORIZON,
    step_minutes: int = STEP_MINUTES,
    shift: int = DAY_MINUTES,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """The :func:`entity_spine`, with ``columns`` read nearest to ``time - shift``.

    Equally near readings: the later wins. The wanted times form a regular grid, so
    one aggregation shrinks the history, map-side, to the earliest and latest reading
    of each series in each grid slot. At most ``periods + 1`` rows per series are
    left to search, however many readings the series has, and the last reading of
    the series is among them.

    With ``entities='last'`` the spine is that of the last row's series, while the
    readings of the whole table are searched.
    """
    if entities not in ("all", "last"):
        raise ValueError(f"entities must be 'all' or 'last', not {entities!r}")
    by = tuple(by)
    search_by = by if entities == "all" else ()
    start = spine_start(history, step_minutes)
    slots = _slot_edges(
        history, search_by, shift_minutes(start, -shift), periods, step_minutes, order
    )
    grouped = slots.groupBy(*search_by) if search_by else slots.groupBy()
    series = grouped.agg(
        # Bounded: one entry per slot.
        F.map_from_entries(
            F.collect_list(F.struct("__slot", F.struct("__earliest", "__latest")))
        ).alias("__slots"),
        F.max_by("__latest", "__slot").alias("__last"),
    ).where(F.col("__last").isNotNull())
    grid = series.select(
        *search_by,
        "__slots",
        "__last",
        F.explode(F.sequence(F.lit(-1), F.lit(periods - 1))).alias(STEP),
    ).withColumn("__edges", F.col("__slots")[F.col(STEP).cast("bigint")])
    # Windows over the slots of one series: bounded, and already in one place.
    forward = Window.partitionBy(*search_by).orderBy(STEP)
    backward = Window.partitionBy(*search_by).orderBy(F.col(STEP).desc())
    first = Window.unboundedPreceding
    time = start + F.make_dt_interval(mins=F.col(STEP) * step_minutes)
    found = grid.select(
        *search_by,
        STEP,
        "__last",
        time.alias(TIME),
        F.last("__edges.__latest", True).over(forward.rowsBetween(first, -1)).alias("__before"),
        F.last("__edges.__earliest", True).over(backward.rowsBetween(first, 0)).alias("__after"),
    ).where(F.col(STEP) >= 0)
    nearer = _nearer("__before", "__after", shift_minutes(TIME, -shift))
    others = [c for c in history.columns if c not in by]
    return found.withColumn("__row", nearer).select(
        *[F.col(c) if c in search_by else F.col(f"__last.{c}") for c in by],
        *[F.col(f"__last.{c}").alias(f"last_{c}") for c in others],
        STEP,
        TIME,
        *[F.col(f"__row.{c}").alias(c) for c in columns],
    )


def persist_last(
    history: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ENTITY,
    entities: str = "all",
    periods: int = HORIZON,
    step_minutes: int = STEP_MINUTES,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """As :func:`persist_nearest`, but every future time gets the last reading."""
    spine = entity_spine(history, by, entities, periods, step_minutes, order)
    return spine.withColumns({c: F.col(f"last_{c}") for c in columns})


def _slot_edges(
    history, by, origin: Column, periods, step_minutes, order
) -> DataFrame:
    """Earliest and latest reading per series and slot.

    Slot k holds the readings from wanted time k up to wanted time k + 1; slot -1
    all earlier ones, the last slot all later ones.
    """
    step = F.lit(step_minutes * 60).cast("decimal(18,6)")
    number = F.floor(seconds_between(F.col(TIME), origin) / step).cast("bigint")
    others = [c for c in order if c in history.columns and c not in by]
    position = F.struct(*others, F.xxhash64(*history.columns).alias("__tie"))
    rest = [c for c in history.columns if c not in by]
    keyed = history.where(F.col(TIME).isNotNull()).withColumn(
        "__slot", F.greatest(F.lit(-1), F.least(number, F.lit(periods - 1)))
    )
    return keyed.groupBy(*by, "__slot").agg(
        F.min_by(F.struct(*rest), position).alias("__earliest"),
        F.max_by(F.struct(*rest), position).alias("__latest"),
    )


def _nearer(before: str, after: str, want: Column) -> Column:
    ahead = seconds_between(F.col(f"{after}.{TIME}"), want)
    behind = seconds_between(want, F.col(f"{before}.{TIME}"))
    return (
        F.when(F.col(after).isNull(), F.col(before))
        .when(F.col(before).isNull() | (ahead <= behind), F.col(after))
        .otherwise(F.col(before))
    )
