"""From raw readings to a clean, filled history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodrift.functions.parsing import lenient_number, nan_to_null, parse_time
from heliodrift.operators.columns import check_columns, drop_null_keys, require_rows
from heliodrift.operators.combine import drop_duplicates
from heliodrift.operators.layout import MAX_SEGMENT_ROWS, choose_cell
from heliodrift.operators.profile import StageCounts
from heliodrift.operators.sequences import fill
from heliodrift.schemas import ENTITY, MEASURES, ORDER, TIME


def with_parsed_time(df: DataFrame) -> DataFrame:
    """Text times parsed, rows without a readable one dropped."""
    if df.schema[TIME].dataType.typeName() == "string":
        df = df.withColumn(TIME, parse_time(TIME))
    return df.na.drop(subset=[TIME])


def fill_measures(
    df: DataFrame,
    columns: Sequence[str] = MEASURES,
    by: Sequence[str] = ENTITY,
    order: Sequence[str] = ORDER,
    number: str | None = None,
    **layout,
) -> DataFrame:
    """Fill, make numeric, then 0 - in that order; NaN is filled like a null.

    So text that is no number becomes 0, not its neighbour's value. Rows without a
    plant or source are dropped last: with ``by=()`` they still lend their values.
    ``number`` names a column for the row numbers of the rows that stay.
    """
    columns = check_columns(df, columns, strict=False)
    text = {f.name for f in df.schema if f.dataType.typeName() == "string"}
    fractional = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    df = df.withColumns({c: nan_to_null(c) for c in columns if c in fractional})
    stays = F.col(ENTITY[0]).isNotNull() & F.col(ENTITY[1]).isNotNull()
    filled = fill(df, columns, by, order, number=number, numbered=stays, **layout)
    numbers = {
        c: F.coalesce(lenient_number(c) if c in text else F.col(c), F.lit(0.0))
        for c in columns
    }
    return drop_null_keys(filled.withColumns(numbers), ENTITY)


def clean(
    df: DataFrame,
    by: Sequence[str] = ENTITY,
    include_time: bool = True,
    max_rows: int = MAX_SEGMENT_ROWS,
    cell: str | None = None,
    guard: bool = False,
    stages: StageCounts | None = None,
) -> DataFrame:
    """Parse times, drop duplicates, fill. ``by=()`` fills over all series at once.

    Measures read with ``raw=True`` are text, so that what is no number becomes 0 and not
    its neighbour's value. ``guard`` raises if no row is left, at the cost of a look.

    The split is chosen before duplicates go, on the cheaper frame; dropping rows can
    only make segments smaller. ``stages`` counts the rows of each step as the job runs.
    """
    parsed = with_parsed_time(df)
    if cell is None:
        order = tuple(c for c in ORDER if c not in by)
        cell = choose_cell(parsed, by, order, max_rows)
    if stages:
        parsed = stages.watch("parsed", with_parsed_time(stages.watch("loaded", df)))
    unique = drop_duplicates(parsed, include_time)
    if stages:
        unique = stages.watch("distinct", unique)
    filled = fill_measures(unique, by=by, max_rows=max_rows, cell=cell)
    if stages:
        filled = stages.watch("filled", filled)
    return require_rows(filled) if guard else filled
