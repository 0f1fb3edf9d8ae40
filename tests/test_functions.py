"""Parsing, calendar and measure expressions."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from heliodrift.functions.calendar import (
    calendar_parts,
    cyclical_parts,
    day,
    seconds_between,
    shift_minutes,
    time_of_day,
)
from heliodrift.functions.measures import clamp_at_zero, energy, zero_if_null
from heliodrift.functions.parsing import (
    lenient_number,
    nan_to_null,
    parse_time,
    parse_time_format,
    parse_time_strict,
)


def evaluate(spark, text, expression, kind="string"):
    df = spark.createDataFrame([(text,)], f"x {kind}")
    return df.select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("15-05-2020 00:00", datetime(2020, 5, 15)),
        ("06-05-2020 13:45", datetime(2020, 5, 6, 13, 45)),
        ("2020-05-15 00:00:00", datetime(2020, 5, 15)),
        # ISO is never day first.
        ("2020-05-06 00:00:00", datetime(2020, 5, 6)),
        ("2020-05-06", datetime(2020, 5, 6)),
        ("2020-05-06T07:08:09.5", datetime(2020, 5, 6, 7, 8, 9, 500000)),
        ("2020-02-29 12:00", datetime(2020, 2, 29, 12)),
        ("2019-02-29 12:00", None),
        ("31-13-2020 00:00", None),
        ("2020", None),
        ("junk", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_time(spark, text, expected):
    assert evaluate(spark, text, parse_time) == expected


def test_parse_time_over_a_clock_change(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert evaluate(spark, "2020-03-08 02:30:00", parse_time) == datetime(2020, 3, 8, 2, 30)
        gap = seconds_between(
            F.lit("2020-03-08 12:00:00").cast("timestamp_ntz"),
            F.lit("2020-03-07 12:00:00.5").cast("timestamp_ntz"),
        )
        assert float(spark.range(1).select(gap).first()[0]) == 86399.5
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_strict_parsing_raises(spark):
    assert evaluate(spark, None, parse_time_strict) is None
    assert evaluate(spark, "15-05-2020 00:00", parse_time_strict) == datetime(2020, 5, 15)
    with pytest.raises(Exception, match="unreadable time: junk"):
        evaluate(spark, "junk", parse_time_strict)
    pattern = lambda c: parse_time_format(c, "dd-MM-yyyy HH:mm")
    assert evaluate(spark, "15-05-2020 00:15", pattern) == datetime(2020, 5, 15, 0, 15)
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP"):
        evaluate(spark, "2020-05-15 00:15", pattern)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("x", None), (" 2 ", 2.0), ("1e3", 1000.0), ("", None), (None, None),
        ("-.5", -0.5), ("1d", None), ("1f", None), ("NaN", None), ("0x10", None),
        ("inf", math.inf), ("-Infinity", -math.inf), ("+3.", 3.0), ("1,5", None),
    ],
)
def test_lenient_number(spark, text, expected):
    assert evaluate(spark, text, lenient_number) == expected


def test_nan_and_null(spark):
    assert evaluate(spark, math.nan, nan_to_null, "double") is None
    assert evaluate(spark, 2.0, nan_to_null, "double") == 2.0
    assert evaluate(spark, None, zero_if_null, "double") == 0.0


def test_calendar_of_a_leap_year(spark):
    times = [(datetime(2020, 12, 31, 23, 45),), (datetime(2020, 2, 29),), (datetime(2020, 5, 18),)]
    df = spark.createDataFrame(times, "DATE_TIME timestamp_ntz")
    parts = [r.asDict() for r in df.withColumns(calendar_parts()).collect()]
    assert [p["dayofyear"] for p in parts] == [366, 60, 139]
    # Monday is 0.
    assert [p["dayofweek"] for p in parts] == [3, 5, 0]
    assert (parts[0]["hour"], parts[0]["minute"], parts[0]["month"]) == (23, 45, 12)
    last = df.withColumns(cyclical_parts()).first()
    assert last["dayofyear_sin"] == pytest.approx(math.sin(2 * math.pi * 366 / 365))
    assert last["timeofday_cos"] == pytest.approx(math.cos(2 * math.pi * 1425 / 1440))
    row = df.select(time_of_day(), day(), shift_minutes("DATE_TIME", 15), shift_minutes("DATE_TIME", -1440)).first()
    assert tuple(row) == (
        "23:45:00", date(2020, 12, 31), datetime(2021, 1, 1), datetime(2020, 12, 30, 23, 45),
    )


def test_clamp_and_energy(spark):
    assert evaluate(spark, -3.0, clamp_at_zero, "double") == 0.0
    assert evaluate(spark, 3.0, clamp_at_zero, "double") == 3.0
    assert math.isnan(evaluate(spark, math.nan, clamp_at_zero, "double"))
    assert evaluate(spark, None, clamp_at_zero, "double") == 0.0
    assert evaluate(spark, 10.0, energy, "double") == 2.5
