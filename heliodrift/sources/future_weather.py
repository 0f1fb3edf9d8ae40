"""Weather for the forecast period: from a file if it is usable, else persistence."""

from __future__ import annotations

from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodrift.functions.parsing import (
    lenient_number,
    nan_to_null,
    parse_time,
    parse_time_strict,
)
from heliodrift.operators.columns import MissingColumns, check_columns
from heliodrift.operators.combine import DuplicateTimes, align_to_spine
from heliodrift.operators.sequences import fill
from heliodrift.schemas import FUTURE_WEATHER_SCHEMA, TIME, WEATHER
from heliodrift.sources.csv_files import read_text


class UnfillableWeather(ValueError):
    """A weather column has no value at all in the forecast period."""


class UnreadableTimes(ValueError):
    """A time of the file is in no known format."""


class FutureWeather(NamedTuple):
    frame: DataFrame | None
    reason: str


def align_weather(spine: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather on the spine: aligned, made numeric, filled both ways, checked.

    The spine has one row per step of the horizon, so one window over it is bounded.
    """
    check_columns(weather, FUTURE_WEATHER_SCHEMA.fieldNames())
    columns = [c for c in weather.columns if c in FUTURE_WEATHER_SCHEMA.fieldNames()]
    text = {f.name for f in weather.schema if f.dataType.typeName() == "string"}
    typed = weather.select(*columns).withColumns(
        {c: lenient_number(c) if c in text else nan_to_null(c) for c in WEATHER}
    )
    if TIME in text:
        typed = typed.withColumn(TIME, parse_time_strict(TIME))
    aligned = align_to_spine(spine, typed)
    return fill(aligned, WEATHER, by=(), order=(TIME,), cell="DAY")


def load_future_weather(
    spark: SparkSession, spine: DataFrame, path: str | None = None
) -> FutureWeather:
    """Future weather from ``path``; ``frame`` is None with a reason if unusable.

    The caller then falls back to persistence. An error of a job that reads the file, such as
    a folder of files with different headers, is such a reason too.
    """
    if not path:
        return FutureWeather(None, "no path given")
    try:
        text = read_text(spark, path)
        check_columns(text, FUTURE_WEATHER_SCHEMA.fieldNames())
        parsed = text.withColumn("__time", parse_time(TIME))
        bad = parsed.where(F.col(TIME).isNotNull() & F.col("__time").isNull())
        if not bad.isEmpty():
            raise UnreadableTimes("unreadable time in the file")
        filled = align_weather(spine, parsed.withColumn(TIME, F.col("__time")).drop("__time"))
        gaps = filled.agg(
            *[F.bool_or(F.col(c).isNull()).alias(c) for c in WEATHER]
        ).first()
        empty = [c for c in WEATHER if gaps[c]]
        if empty:
            raise UnfillableWeather(f"no values for {', '.join(empty)}")
    except (MissingColumns, DuplicateTimes, UnfillableWeather, UnreadableTimes) as problem:
        return FutureWeather(None, str(problem))
    except (PySparkException, Py4JJavaError) as problem:
        return FutureWeather(None, str(problem).splitlines()[0])
    return FutureWeather(filled, "read from file")
