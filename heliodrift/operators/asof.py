"""As-of join for any wanted times: the reading nearest to each row, found in one merged order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliodrift.functions.calendar import seconds_between
from heliodrift.operators.layout import MAX_SEGMENT_ROWS, SEGMENT, lay_out
from heliodrift.schemas import TIME

DIRECTIONS = ("nearest", "backward", "forward")
_WANTED, _READING, _KIND = "__wanted", "__reading", "__kind"


def nearest_rows(
    wanted: DataFrame,
    readings: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    time: str = TIME,
    order: Sequence[str] = (),
    tolerance: float | None = None,
    direction: str = "nearest",
    max_rows: int = MAX_SEGMENT_ROWS,
    cell: str | None = None,
) -> DataFrame:
    """Every row of ``wanted`` with ``columns`` of a reading of its series, and that one's time.

    ``backward`` takes the last reading before the wanted time or at it, ``forward`` the first one
    at it or after, ``nearest`` the nearer of both, the later if they are equally near. Of
    readings at one time the first one in ``order`` is at hand going forward, the last one
    going backward; a reading at the wanted time itself is one going forward, but for
    ``backward``. Further off than ``tolerance`` seconds there is none, nor for a null time; null keys are
    equal to each other.

    Both tables are merged into one order and laid out in segments, so a series of any length
    spreads over tasks. Inside a segment the last reading is carried forward and the first one
    backward; what comes from other segments is read off a table with one row a segment. No
    row is compared with more than two readings, however many fall into the tolerance.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}, not {direction!r}")
    found_time = f"{time}_found"
    clash = [c for c in (*columns, found_time) if c in wanted.columns]
    if clash:
        raise ValueError(f"columns of both tables: {', '.join(clash)}")
    by, rest = tuple(by), [c for c in order if c not in (time, *by)]
    events = _events(wanted, readings, columns, by, time, rest, last=direction == "backward")
    layout = lay_out(events, by, (time, _KIND, *rest), max_rows, cell)
    start, here = Window.unboundedPreceding, Window.currentRow
    last = F.last(_READING, ignorenulls=True)
    frame = layout.frame.withColumns(
        {
            "__before": last.over(layout.window().rowsBetween(start, here)),
            # Descending, since a frame up to the last row would be walked for every row.
            "__after": last.over(layout.window(descending=True).rowsBetween(start, here)),
        }
    )
    if not layout.whole:
        place = F.when(F.col(_READING).isNotNull(), layout.position)
        table = layout.summary(
            F.min_by(_READING, place).alias("__first"), F.max_by(_READING, place).alias("__last")
        ).select(
            *by,
            SEGMENT,
            F.last("__last", True).over(layout.across().rowsBetween(start, -1)).alias("__earlier"),
            F.last("__first", True).over(layout.across(True).rowsBetween(start, -1)).alias("__later"),
        )
        frame = layout.attach(frame, table).withColumns(
            {"__before": F.coalesce("__before", "__earlier"), "__after": F.coalesce("__after", "__later")}
        )
    chosen = frame.where(F.col(_WANTED).isNotNull()).withColumn(
        "__found", _chosen(direction, time, tolerance)
    )
    return chosen.select(
        f"{_WANTED}.*",
        F.col(f"__found.{time}").alias(found_time),
        *[F.col(f"__found.{c}").alias(c) for c in columns],
    )


def _events(
    wanted: DataFrame, readings: DataFrame, columns: Sequence[str], by: tuple[str, ...], time: str, rest: list[str], last: bool
) -> DataFrame:
    """Both tables in one shape; at one time wanted rows come first, or ``last``."""
    asked = wanted.select(
        *by, time, F.lit(2 if last else 0).alias(_KIND), F.struct(*wanted.columns).alias(_WANTED)
    )
    kept = list(dict.fromkeys([time, *columns]))
    given = readings.where(F.col(time).isNotNull()).select(
        *by, time, F.lit(1).alias(_KIND), *rest, F.struct(*kept).alias(_READING)
    )
    return given.unionByName(asked, allowMissingColumns=True)


def _chosen(direction: str, time: str, tolerance: float | None) -> Column:
    wanted = F.col(time)
    behind = seconds_between(wanted, F.col(f"__before.{time}")) if direction != "forward" else F.lit(None)
    ahead = seconds_between(F.col(f"__after.{time}"), wanted) if direction != "backward" else F.lit(None)
    behind, ahead = behind.cast("decimal(18,6)"), ahead.cast("decimal(18,6)")
    after = behind.isNull() | (ahead <= behind)
    nearer = F.when(after & ahead.isNotNull(), F.col("__after")).when(behind.isNotNull(), F.col("__before"))
    if tolerance is None:
        return F.when(wanted.isNotNull(), nearer)
    near_enough = F.least(behind, ahead) <= F.lit(tolerance).cast("decimal(18,6)")
    return F.when(wanted.isNotNull() & near_enough, nearer)
