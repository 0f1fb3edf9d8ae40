"""Joins, unions and de-duplication of readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodrift.schemas import PLANT, TIME


def join_weather(
    generation: DataFrame, weather: DataFrame, on: Sequence[str] = (TIME, PLANT)
) -> DataFrame:
    """Left join with null keys matching each other and duplicate keys fanning out.

    No hint is given: adaptive execution broadcasts the weather when its measured
    size is under the session's threshold, else sort-merges and cuts an oversized
    generation partition (one plant and time holding a large share of the rows)
    into slices, which a left join allows on its left side.
    """
    condition = None
    for key in on:
        same = generation[key].eqNullSafe(weather[key])
        condition = same if condition is None else condition & same
    measures = [weather[c] for c in weather.columns if c not in on]
    return generation.join(weather, condition, "left").select(
        *[generation[c] for c in generation.columns], *measures
    )


def union_plants(*frames: DataFrame) -> DataFrame:
    """All rows, matched by column name; absent columns become null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def drop_duplicates(
    df: DataFrame, include_time: bool = True, time: str = TIME
) -> DataFrame:
    """Keep one of equal rows, nulls being equal to each other.

    With ``include_time=False`` rows equal in everything but time collapse to the
    earliest. Both are plain aggregations, so a large group of copies shrinks
    before the shuffle.
    """
    if include_time:
        return df.dropDuplicates()
    others = [c for c in df.columns if c != time]
    return df.groupBy(*others).agg(F.min(time).alias(time)).select(*df.columns)


class DuplicateTimes(ValueError):
    """A frame that must have unique timestamps has repeated ones."""


def align_to_spine(spine: DataFrame, values: DataFrame, time: str = TIME) -> DataFrame:
    """Values at the spine's timestamps: extra times vanish, gaps become null."""
    repeated = values.groupBy(time).count().where("count > 1")
    if not repeated.isEmpty():
        raise DuplicateTimes(f"repeated values in {time}")
    return spine.join(values, time, "left")
