"""How ordered rows are split over tasks.

A window without ``partitionBy`` runs in one task, and so does a window over one
series that holds a third of the table. Every order-dependent operator therefore
works on *segments*: consecutive runs of the total order, each small enough for a
task. It computes inside the segments, then adds what the earlier segments of the
same series carry in, taken from a table with one row per segment.

Choosing the segments costs one pruned, map-side combined count:

* ``WHOLE``  - each series fits a task: plain windows, no second pass;
* ``DAY``, ``HOUR``, ``MINUTE`` - the coarsest calendar cell that fits. The cell is
  an expression of the time column, so nothing is written and the frame is
  shuffled once, on (series, cell);
* ``RANGE``  - even a minute is too big (a flood of equal timestamps): the rows are
  range-partitioned on the full order plus a row number and written to the shared
  checkpoint folder, since range bounds are sampled and a recomputation might cut
  elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from heliodrift.schemas import ORDER, TIME
from heliodrift.session import shared_folder

SEGMENT = "__segment"
GROUP = "__group"
TIE = "__tie"
ROW = "__row"
WORK_COLUMNS = (SEGMENT, GROUP, TIE, ROW)

# About 100 MB of a dozen narrow columns: comfortable for one task to sort.
MAX_SEGMENT_ROWS = 1_000_000
CELLS = ("WHOLE", "DAY", "HOUR", "MINUTE")
_NO_TIME = -(2**62)


@dataclass(frozen=True)
class Layout:
    """A frame with its series, order and segments."""

    frame: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    cell: str

    @property
    def whole(self) -> bool:
        return self.cell == "WHOLE"

    @property
    def position(self) -> Column:
        """One value that orders the rows of a series."""
        return F.struct(*self.order) if len(self.order) > 1 else F.col(self.order[0])

    def window(self, descending: bool = False) -> WindowSpec:
        keys = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        parts = self.by if self.whole else (GROUP,)
        return Window.partitionBy(*parts).orderBy(*keys)

    def across(self, descending: bool = False) -> WindowSpec:
        """Order of the segments of one series, over :meth:`summary`."""
        segment = F.col(SEGMENT)
        return Window.partitionBy(*self.by).orderBy(
            segment.desc() if descending else segment.asc()
        )

    def summary(self, *aggregates: Column) -> DataFrame:
        """One row per series and segment, combined map-side."""
        return self.frame.groupBy(*self.by, SEGMENT).agg(*aggregates)

    def attach(self, frame: DataFrame, summary: DataFrame) -> DataFrame:
        """Join per-segment values back.

        The key is one column, the same the windows partition by, so the big side
        is already placed; fields that are null compare equal inside a struct.
        """
        keyed = summary.withColumn(GROUP, _group(self.by)).drop(*self.by, SEGMENT)
        return frame.join(keyed, GROUP, "left")


def lay_out(
    df: DataFrame,
    by: Sequence[str] = (),
    order: Sequence[str] = ORDER,
    max_rows: int = MAX_SEGMENT_ROWS,
    cell: str | None = None,
) -> Layout:
    """Split ``df`` into segments of at most about ``max_rows`` rows.

    ``by`` names the series columns; empty means one series over the whole table.
    ``cell`` skips the counting, for callers that can prove a bound.
    """
    by = tuple(by)
    order = tuple(c for c in order if c not in by)
    tied = df.withColumn(TIE, F.xxhash64(*df.columns))
    if cell is None:
        cell = choose_cell(df, by, order, max_rows)
    if cell == "RANGE":
        return _range_layout(tied, by, order, max_rows)
    kind = df.schema[order[0]].dataType.typeName()
    frame = tied.withColumn(SEGMENT, cell_number(cell, order[0], kind)).withColumn(
        GROUP, _group(by)
    )
    return Layout(frame, by, order + (TIE,), cell)


def choose_cell(
    df: DataFrame, by: Sequence[str], order: Sequence[str], max_rows: int
) -> str:
    """The coarsest cell whose fullest segment has at most ``max_rows`` rows.

    One pass counts the days, which add up to the whole series; only if no day fits, a
    second one counts the minutes, which add up to the hours.
    """
    time = order[0]
    kind = df.schema[time].dataType.typeName()
    if kind not in ("timestamp_ntz", "timestamp"):
        # Without a time the whole series is the only cell, and never that of a whole table.
        if by and _fullest(df, by, F.lit(0), F.lit(0))[0] <= max_rows:
            return "WHOLE"
        return "RANGE"
    # One series over the whole table is never one window, whatever its size.
    whole, day = _fullest(df, by, F.lit(0), cell_number("DAY", time, kind))
    if by and whole <= max_rows:
        return "WHOLE"
    if day <= max_rows:
        return "DAY"
    hour, minute = _fullest(df, by, cell_number("HOUR", time, kind), cell_number("MINUTE", time, kind))
    return "HOUR" if hour <= max_rows else "MINUTE" if minute <= max_rows else "RANGE"


def _fullest(df: DataFrame, by: Sequence[str], coarse: Column, fine: Column) -> tuple[int, int]:
    """Rows of the fullest coarse and of the fullest fine cell, from one count of the fine ones."""
    counts = df.groupBy(*by, coarse.alias("__coarse"), fine.alias("__fine")).count()
    sums = counts.groupBy(*by, "__coarse").agg(F.sum("count").alias("rows"), F.max("count").alias("most"))
    row = sums.agg(F.max("rows"), F.max("most")).first()
    return row[0] or 0, row[1] or 0


def cell_number(cell: str, time: str = TIME, kind: str = "timestamp_ntz") -> Column:
    """A whole number that grows with time, without the session time zone.

    Rows without a time come first, as they do in the total order.
    """
    if cell == "WHOLE":
        return F.lit(0).cast("bigint")
    if kind == "timestamp":
        # Seconds since the epoch grow where the clock of a zone is put back.
        seconds = {"DAY": 86_400, "HOUR": 3_600, "MINUTE": 60}[cell]
        number = F.floor(F.unix_seconds(time) / seconds)
    else:
        number = F.unix_date(F.to_date(time)).cast("bigint")
        if cell in ("HOUR", "MINUTE"):
            number = number * 24 + F.hour(time)
        if cell == "MINUTE":
            number = number * 60 + F.minute(time)
    return F.coalesce(number, F.lit(_NO_TIME).cast("bigint"))


def drop_work_columns(df: DataFrame) -> DataFrame:
    return df.drop(*WORK_COLUMNS)


def _group(by: Sequence[str]) -> Column:
    return F.struct(*by, SEGMENT) if by else F.col(SEGMENT)


def _range_layout(
    tied: DataFrame, by: tuple[str, ...], order: tuple[str, ...], max_rows: int
) -> Layout:
    shared_folder(tied.sparkSession)
    # Written first, so that row numbers stay the same if a task is run again.
    fixed = tied.checkpoint()
    parts = max(2, 2 * -(-fixed.count() // max_rows))
    full = order + (TIE, ROW)
    frame = (
        fixed.withColumn(ROW, F.monotonically_increasing_id())
        .repartitionByRange(parts, *by, *full)
        .withColumn(SEGMENT, F.spark_partition_id().cast("bigint"))
        .checkpoint()
        .withColumn(GROUP, _group(by))
    )
    return Layout(frame, by, full, "RANGE")
