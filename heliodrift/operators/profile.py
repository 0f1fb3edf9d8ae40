"""Aggregations that describe a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from heliodrift.functions.calendar import day, seconds_between
from heliodrift.functions.measures import zero_if_null
from heliodrift.functions.parsing import nan_to_null
from heliodrift.operators.columns import check_columns
from heliodrift.schemas import ENTITY, MEASURES, ORDER, POWER, TIME, YIELDS

SUMMED = POWER + YIELDS


def _sum(column: str) -> Column:
    # The sum of nothing but nulls is 0.
    return zero_if_null(F.sum(column)).alias(column)


def sum_per_timestamp(df: DataFrame, columns: Sequence[str] = SUMMED) -> DataFrame:
    """Plant totals at each timestamp; rows without a time are left out."""
    return df.where(F.col(TIME).isNotNull()).groupBy(TIME).agg(*map(_sum, columns))


def daily_totals(df: DataFrame, columns: Sequence[str] = SUMMED) -> DataFrame:
    """Sums per day. The yields are counters, so their sums are not energy."""
    dated = df.where(F.col(TIME).isNotNull()).withColumn("DATE", day())
    return dated.groupBy("DATE").agg(*map(_sum, columns))


def _without_nan(df: DataFrame, column: str) -> Column:
    fractional = df.schema[column].dataType.typeName() in ("double", "float")
    return nan_to_null(column) if fractional else F.col(column)


def null_profile(df: DataFrame, columns: Sequence[str] = MEASURES) -> DataFrame:
    """One row per column: whether it has nulls (or NaN) and how many, in one pass."""
    columns = check_columns(df, columns, strict=False)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(_without_nan(df, c).isNull()).alias(c) for c in columns],
    )
    return counts.unpivot("rows", list(columns), "column", "null_count").select(
        "column",
        F.col("rows").cast("bigint").alias("rows"),
        F.col("null_count").cast("bigint").alias("null_count"),
        (F.col("null_count") > 0).alias("any_null"),
    )


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns after each named stage."""
    result = None
    for number, (name, frame) in enumerate(stages.items(), 1):
        row = frame.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(number).alias("stage_no"),
            F.lit(name).alias("stage"),
            "rows",
            F.lit(len(frame.columns)).cast("bigint").alias("columns"),
        )
        result = row if result is None else result.unionAll(row)
    return result


class StageCounts:
    """Rows of each stage of a job, counted by the job itself instead of by a scan of their own.

    ``watch`` puts a counter on a frame; what is built on the frame it returns counts as it
    runs. Once an action has run the last stage, ``table`` holds what :func:`stage_counts` would.
    A counter keeps what the first action over its frame saw, and a stage that is run again
    after an executor was lost can count twice; for numbers that must not, use that function.
    """

    def __init__(self) -> None:
        self._stages: list[tuple[str, int, Observation]] = []

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        seen = Observation(f"{len(self._stages)} {name}")
        self._stages.append((name, len(df.columns), seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each stage; waits for the action that runs them."""
        rows = [
            (number, name, seen.get["rows"], columns)
            for number, (name, columns, seen) in enumerate(self._stages, 1)
        ]
        return spark.createDataFrame(rows, "stage_no int, stage string, rows bigint, columns bigint")


def over_two_values(
    df: DataFrame, columns: Sequence[str]
) -> dict[str, tuple[bool, bool]]:
    """Whether each column has more than two distinct values.

    The second answer counts null as a value. Exact without counting distinct
    values: there are more than two if some value lies strictly between the least
    and the greatest. The driver gets two one-row results.
    """
    if not columns:
        return {}
    ends = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns],
        *[F.max(c).alias(f"hi_{c}") for c in columns],
        *[F.count_if(F.col(c).isNull()).alias(f"gaps_{c}") for c in columns],
    ).first()
    # Null ends (no values) differ from nothing.
    varied = [c for c in columns if ends[f"lo_{c}"] != ends[f"hi_{c}"]]
    inside = {}
    if varied:
        inside = df.agg(
            *[
                F.bool_or(
                    (F.col(c) > ends[f"lo_{c}"]) & (F.col(c) < ends[f"hi_{c}"])
                ).alias(c)
                for c in varied
            ]
        ).first().asDict()
    return {
        c: (
            bool(inside.get(c)),
            bool(inside.get(c)) or (c in varied and ends[f"gaps_{c}"] > 0),
        )
        for c in columns
    }


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct values per column, with and without null as a value.

    Values keep their own type; NaN counts as null.
    """
    # Long form first: each (column, value) pair is one grouping key, so the work
    # spreads over all values instead of one task per column.
    # Partial counts per value also shrink a value held by most rows.
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    counted = []
    for names in by_type.values():
        long = df.select(*[_without_nan(df, c).alias(c) for c in names]).unpivot(
            [], names, "column", "value"
        )
        values = long.groupBy("column", "value").count()
        counted.append(
            values.groupBy("column").agg(
                F.count("value").alias("distinct_values"),
                F.count(F.lit(1)).alias("distinct_with_null"),
            )
        )
    return reduce(DataFrame.unionByName, counted)


def latest_time(df: DataFrame) -> Column:
    """The latest timestamp as a scalar subquery, so it stays inside the plan."""
    return df.select(F.max(TIME)).scalar()


def at_latest(df: DataFrame) -> DataFrame:
    """All rows at the latest timestamp."""
    return df.where(F.col(TIME) == latest_time(df))


def first_at_latest(df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The first row, in the total order, at the latest timestamp, in one pass."""
    age = seconds_between(F.lit("2200-01-01").cast("timestamp_ntz"), F.col(TIME))
    rest = [c for c in order if c != TIME and c in df.columns]
    position = F.struct(age.alias("age"), *rest, F.xxhash64(*df.columns).alias("__tie"))
    found = df.where(F.col(TIME).isNotNull()).agg(
        F.min_by(F.struct(*df.columns), position).alias("__row")
    )
    return found.where(F.col("__row").isNotNull()).select("__row.*")


def last_rows(
    df: DataFrame, by: Sequence[str] = ENTITY, order: Sequence[str] = ORDER
) -> DataFrame:
    """The last row of each series, or of the table when ``by`` is empty."""
    return _edge_rows(df, by, order, F.max_by)


def first_rows(
    df: DataFrame, by: Sequence[str] = ENTITY, order: Sequence[str] = ORDER
) -> DataFrame:
    return _edge_rows(df, by, order, F.min_by)


def _edge_rows(df, by, order, pick) -> DataFrame:
    others = [c for c in df.columns if c not in by]
    position = F.struct(
        *[c for c in order if c in others], F.xxhash64(*df.columns).alias("__tie")
    )
    grouped = df.groupBy(*by) if by else df.groupBy()
    found = grouped.agg(pick(F.struct(*others), position).alias("__row"))
    # Without keys an empty table still aggregates to one row, of null.
    return (
        found.where(F.col("__row").isNotNull())
        .select(*by, "__row.*")
        .select(*df.columns)
    )


def head(df: DataFrame, rows: int = 5, order: Sequence[str] = ORDER) -> DataFrame:
    """The first rows in the total order, ties settled by content."""
    return df.orderBy(*_total_order(df, order)).limit(rows)


def tail(df: DataFrame, rows: int, order: Sequence[str] = ORDER) -> DataFrame:
    """The last rows of the total order, in that order (a top-n, not a full sort)."""
    ordered = _total_order(df, order)
    return df.orderBy(*[c.desc() for c in ordered]).limit(rows).orderBy(*ordered)


def tail_per_series(
    df: DataFrame, rows: int, by: Sequence[str] = ENTITY, order: Sequence[str] = ORDER
) -> DataFrame:
    """The last rows of each series; tasks keep no more than these before the shuffle."""
    ordered = [c.desc() for c in _total_order(df, [c for c in order if c not in by])]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*ordered))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= rows).drop("__rank")


def _total_order(df: DataFrame, order: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in order if c in df.columns] + [F.xxhash64(*df.columns)]


def power_by_time_of_day(df: DataFrame) -> DataFrame:
    """Plant totals of both powers at each timestamp, with its time of day."""
    return sum_per_timestamp(df, POWER).select(
        F.date_format(TIME, "HH:mm:ss").alias("time"), "AC_POWER", "DC_POWER"
    )


def yield_over_time(df: DataFrame) -> DataFrame:
    return sum_per_timestamp(df, ("DAILY_YIELD",))
