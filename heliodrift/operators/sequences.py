"""Order-dependent operators: row numbers, running totals, fills, lags, means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliodrift.operators.layout import (
    GROUP,
    MAX_SEGMENT_ROWS,
    SEGMENT,
    Layout,
    drop_work_columns,
    lay_out,
)
from heliodrift.schemas import ENTITY, LAGS, MEAN_ROWS, ORDER

_FIRST, _LAST, _HERE = Window.unboundedPreceding, Window.unboundedFollowing, 0
_NUMBER = "__number"
# Lag buckets are cut by row number, so they may be small; the halo is a few rows.
BUCKET_ROWS = 200_000


def row_numbers(
    df: DataFrame,
    name: str,
    by: Sequence[str] = (),
    order: Sequence[str] = ORDER,
    max_rows: int = MAX_SEGMENT_ROWS,
    cell: str | None = None,
) -> DataFrame:
    """Number the rows of each series from 1 in the total order."""
    return drop_work_columns(_numbered(lay_out(df, by, order, max_rows, cell), name))


def _numbered(layout: Layout, name: str) -> DataFrame:
    local = layout.frame.withColumn(
        name, F.row_number().over(layout.window()).cast("bigint")
    )
    if layout.whole:
        return local
    earlier = layout.across().rowsBetween(_FIRST, -1)
    table = layout.summary(F.count(F.lit(1)).alias("__rows")).select(
        *layout.by,
        SEGMENT,
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"),
    )
    return (
        layout.attach(local, table)
        .withColumn(name, F.col(name) + F.col("__before"))
        .drop("__before")
    )


def running_total(
    df: DataFrame,
    value: Column | str,
    name: str,
    by: Sequence[str] = ENTITY,
    order: Sequence[str] = ORDER,
    seed: Column | float = 0.0,
    max_rows: int = MAX_SEGMENT_ROWS,
    cell: str | None = None,
) -> DataFrame:
    """``seed`` plus the running sum of ``value`` along each series.

    A null adds nothing, at the start of a series too.
    """
    value = F.col(value) if isinstance(value, str) else value
    layout = lay_out(df, by, order, max_rows, cell)
    total = F.sum(value).over(layout.window().rowsBetween(_FIRST, _HERE))
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    if layout.whole:
        whole = seed + F.coalesce(total, F.lit(0.0))
        return drop_work_columns(layout.frame.withColumn(name, whole))
    earlier = layout.across().rowsBetween(_FIRST, -1)
    table = layout.summary(F.sum(value).alias("__sum")).select(
        *layout.by,
        SEGMENT,
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0)).alias("__before"),
    )
    joined = layout.attach(layout.frame.withColumn(name, total), table)
    joined = joined.withColumn(
        name, seed + F.col("__before") + F.coalesce(F.col(name), F.lit(0.0))
    )
    return drop_work_columns(joined.drop("__before"))


def fill(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ENTITY,
    order: Sequence[str] = ORDER,
    direction: str = "forward",
    max_rows: int = MAX_SEGMENT_ROWS,
    cell: str | None = None,
    number: str | None = None,
    numbered: Column | None = None,
) -> DataFrame:
    """Fill nulls along each series.

    ``forward`` takes the last earlier value, then the first value of the series
    for what is left at its start. ``backward`` is the mirror image. Columns
    without nulls come back unchanged, all-null columns stay null.

    ``number`` also names a column for the row number among the rows for which
    ``numbered`` holds (all by default). It costs no pass of its own here, and
    :func:`lags_and_means` can go on from it.
    """
    layout = lay_out(df, by, order, max_rows, cell)
    return drop_work_columns(_filled(layout, columns, direction, number, numbered))


def _filled(
    layout: Layout,
    columns: Sequence[str],
    direction: str,
    number: str | None = None,
    numbered: Column | None = None,
) -> DataFrame:
    backward = direction == "backward"
    # A frame that ends at the last row is quadratic, so backward runs over the
    # descending order instead.
    here = layout.window(descending=backward).rowsBetween(_FIRST, _HERE)
    near = {c: F.last(c, ignorenulls=True).over(here) for c in columns}
    rows = F.count(F.lit(1) if numbered is None else F.when(numbered, 1))
    if number:
        near[number] = rows.over(layout.window().rowsBetween(_FIRST, _HERE))
    if layout.whole:
        all_rows = layout.window(descending=backward).rowsBetween(_FIRST, _LAST)
        for c in columns:
            near[c] = F.coalesce(near[c], F.first(c, True).over(all_rows))
        return layout.frame.withColumns(near)

    aggregates = [rows.alias("__rows")] if number else []
    for c in columns:
        seen = F.when(F.col(c).isNotNull(), layout.position)
        aggregates += [
            F.min_by(c, seen).alias(f"__first_{c}"),
            F.max_by(c, seen).alias(f"__last_{c}"),
        ]
    carried, ends = ("first", "last") if backward else ("last", "first")
    across = layout.across(descending=backward)
    earlier, everything = across.rowsBetween(_FIRST, -1), across.rowsBetween(_FIRST, _LAST)
    carry = []
    for c in columns:
        carry += [
            F.last(f"__{carried}_{c}", True).over(earlier).alias(f"__carry_{c}"),
            F.first(f"__{ends}_{c}", True).over(everything).alias(f"__edge_{c}"),
        ]
    done = {c: F.coalesce(c, f"__carry_{c}", f"__edge_{c}") for c in columns}
    if number:
        before = F.sum("__rows").over(layout.across().rowsBetween(_FIRST, -1))
        carry.append(F.coalesce(before, F.lit(0)).alias("__before"))
        done[number] = F.col(number) + F.col("__before")
    table = layout.summary(*aggregates).select(*layout.by, SEGMENT, *carry)
    joined = layout.attach(layout.frame.withColumns(near), table)
    spent = [f"__{kind}_{c}" for c in columns for kind in ("carry", "edge")]
    return joined.withColumns(done).drop("__before", *spent)


def lag_name(column: str, rows: int) -> str:
    return f"{column}_lag_{rows}"


def mean_name(column: str, rows: int) -> str:
    return f"{column}_roll_mean_{rows}"


def lag_mean_names(
    columns: Sequence[str], lags: Sequence[int] = LAGS, mean_rows: int = MEAN_ROWS
) -> list[str]:
    return [
        name
        for c in columns
        for name in [*(lag_name(c, n) for n in lags), mean_name(c, mean_rows)]
    ]


def lags_and_means(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ENTITY,
    order: Sequence[str] = ORDER,
    lags: Sequence[int] = LAGS,
    mean_rows: int = MEAN_ROWS,
    null_free: bool = False,
    max_rows: int = MAX_SEGMENT_ROWS,
    cell: str | None = None,
    number: str | None = None,
) -> DataFrame:
    """Add row lags and a trailing mean, then fill them backward, forward, with 0.

    Lags count rows of the series, not hours. Rows too early for a lag take the
    first lagged value; a series shorter than the lag gets 0. ``null_free`` states
    that ``columns`` hold no nulls (they were filled before), which settles the
    backward fill without another pass. ``number`` names a column with the gapless
    row numbers of each series, as :func:`fill` leaves it; it is used up.
    """
    by = tuple(by)
    reach = max([*lags, mean_rows - 1])
    if number:
        frame, whole = df.withColumnRenamed(number, _NUMBER), cell == "WHOLE"
    else:
        layout = lay_out(df, by, order, max_rows, cell)
        frame, whole = _numbered(layout, _NUMBER), layout.whole
    parts = by
    if not whole:
        rows = max(min(max_rows, BUCKET_ROWS), reach + 1)
        frame = _with_halo(frame, by, rows, reach)
        parts = (GROUP,)
    window = Window.partitionBy(*parts).orderBy(_NUMBER)
    trailing, all_rows = window.rowsBetween(1 - mean_rows, _HERE), window.rowsBetween(_FIRST, _LAST)

    added = {}
    for c in columns:
        for n in lags:
            lagged = F.lag(c, n).over(window)
            if null_free:
                # Only the first n rows lack a lag; they sit in the first bucket,
                # together with row 1, whose value is the first lagged one.
                long_enough = F.count(F.lit(1)).over(all_rows) > n
                early = F.when(long_enough, F.first(c).over(all_rows)).otherwise(0.0)
                lagged = F.when(F.col(_NUMBER) > n, lagged).otherwise(early)
            added[lag_name(c, n)] = lagged
        added[mean_name(c, mean_rows)] = F.avg(c).over(trailing)
    frame = frame.withColumns(added)
    if not whole:
        frame = frame.where("__own").drop("__own")
    if not null_free:
        placed = Layout(frame, by, (_NUMBER,), "WHOLE" if whole else "BUCKET")
        frame = _filled(placed, list(added), "backward")
        frame = frame.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in added})
    return drop_work_columns(frame.drop(_NUMBER))


def _with_halo(
    numbered: DataFrame, by: tuple[str, ...], bucket_rows: int, reach: int
) -> DataFrame:
    """Equal buckets by row number, each with the last ``reach`` rows before it."""
    bucket = F.expr(f"({_NUMBER} - 1) div {bucket_rows}")
    offset = F.expr(f"({_NUMBER} - 1) % {bucket_rows}")
    wanted = F.when(
        offset >= bucket_rows - reach, F.array(bucket, bucket + 1)
    ).otherwise(F.array(bucket))
    return (
        numbered.withColumn(SEGMENT, F.explode(wanted))
        .withColumn("__own", F.col(SEGMENT) == bucket)
        .withColumn(GROUP, F.struct(*by, SEGMENT) if by else F.col(SEGMENT))
    )
