"""Spines, nearest readings, yields, features and reports."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import collected, combined_rows, to_spark
from pyspark.sql import functions as F

from heliodrift.operators.nearest import persist_last, persist_nearest
from heliodrift.operators.sequences import lag_mean_names
from heliodrift.operators.spine import entity_spine, future_spine
from heliodrift.operators.yields import add_yields
from heliodrift.plans.features import future_features, history_features
from heliodrift.plans.persistence import (
    FORECAST_COLUMNS,
    persistence_forecast,
    persistence_weather,
)
from heliodrift.plans.reports import forecast_output, long_frame
from heliodrift.schemas import COMBINED_SCHEMA, ENTITY, HORIZON, POWER, WEATHER

QUARTER = timedelta(minutes=15)
KEYED = "DATE_TIME timestamp_ntz, PLANT_ID int, SOURCE_KEY string, v double"


def brute_nearest(history, by, column):
    """Every (series, step) by full search; the later of two equally near wins."""
    start = history["DATE_TIME"].max() + QUARTER
    found = {}
    groups = history.groupby(list(by)) if by else [((), history)]
    for key, rows in groups:
        for step in range(HORIZON):
            want = start + step * QUARTER - timedelta(days=1)
            distance = (rows["DATE_TIME"] - want).abs()
            nearest = rows[distance == distance.min()]
            time = nearest["DATE_TIME"].max()
            ties = nearest[nearest["DATE_TIME"] == time]
            # Among equal times: the first row at or after, the last row before.
            found[(*key, step)] = ties[column].iloc[0 if time >= want else -1]
    return found


def random_history(seed, minutes):
    rng = np.random.default_rng(seed)
    table = combined_rows(300, seed=seed)
    start = datetime(2020, 5, 15)
    # Half the rows share one minute; sources end at different times.
    offset = np.where(rng.random(300) < 0.5, 900, rng.integers(0, minutes, 300))
    table["DATE_TIME"] = [start + timedelta(minutes=int(m)) for m in offset]
    table = table.drop_duplicates(["DATE_TIME", "PLANT_ID", "SOURCE_KEY"])
    return table.sort_values(["DATE_TIME", "PLANT_ID", "SOURCE_KEY"])


@pytest.mark.parametrize("minutes", [1000, 3000, 20000])
def test_nearest_equals_full_search(spark, minutes):
    table = random_history(1, minutes)
    df = to_spark(spark, table)
    got = persist_nearest(df, ["DAILY_YIELD"]).collect()
    expected = brute_nearest(table, ENTITY, "DAILY_YIELD")
    assert len(got) == len(expected)
    for r in got:
        assert r["DAILY_YIELD"] == expected[r["PLANT_ID"], r["SOURCE_KEY"], r["step"]]
    shared = persist_nearest(df, ["DAILY_YIELD"], entities="last").collect()
    expected = brute_nearest(table, (), "DAILY_YIELD")
    assert {(r["step"],): r["DAILY_YIELD"] for r in shared} == expected
    last = table.iloc[-1]
    assert {(r["PLANT_ID"], r["SOURCE_KEY"]) for r in shared} == {(last["PLANT_ID"], last["SOURCE_KEY"])}


def test_equally_near_takes_the_later(spark):
    end = datetime(2020, 5, 16)
    want = end + QUARTER - timedelta(days=1)
    rows = [(want - timedelta(minutes=5), 1, "A", 1.0), (want + timedelta(minutes=5), 1, "A", 2.0), (end, 1, "A", 3.0)]
    df = spark.createDataFrame(rows, KEYED)
    values = {r["step"]: r["v"] for r in persist_nearest(df, ["v"]).collect()}
    assert values[0] == 2.0 and values[95] == 3.0 and len(values) == HORIZON
    rows[0] = (want - timedelta(minutes=4, seconds=59), 1, "A", 1.0)
    df = spark.createDataFrame(rows, KEYED)
    assert persist_nearest(df, ["v"]).where("step = 0").first()["v"] == 1.0


def test_last_mode_and_empty_history(spark):
    rows = [(datetime(2020, 5, 15), 1, "A", 1.0), (datetime(2020, 5, 16), 1, "A", 2.0), (datetime(2020, 5, 14), 2, "B", 5.0)]
    df = spark.createDataFrame(rows, KEYED)
    found = persist_last(df, ["v"])
    assert {(r["SOURCE_KEY"], r["v"]) for r in found.collect()} == {("A", 2.0), ("B", 5.0)}
    assert found.count() == 2 * HORIZON
    assert persist_last(df, ["v"], entities="last").count() == HORIZON
    nothing = df.where("false")
    for entities in ("all", "last"):
        assert persist_nearest(nothing, ["v"], entities=entities).isEmpty()
        assert persist_last(nothing, ["v"], entities=entities).isEmpty()
    assert future_spine(nothing).isEmpty()
    with pytest.raises(ValueError):
        persist_nearest(df, ["v"], entities="some")


def test_spines_start_after_the_latest_reading(spark):
    rows = [(datetime(2020, 5, 15, 1), 1, "A", 1.0), (datetime(2020, 5, 15, 9), 2, "B", 2.0)]
    df = spark.createDataFrame(rows, KEYED)
    times = [r["DATE_TIME"] for r in future_spine(df).orderBy("step").collect()]
    assert times == [datetime(2020, 5, 15, 9) + QUARTER * i for i in range(1, 97)]
    spine = entity_spine(df)
    assert spine.where("SOURCE_KEY = 'A'").orderBy("step").first()["DATE_TIME"] == times[0]
    assert spine.where("SOURCE_KEY = 'A'").first()["last_DATE_TIME"] == rows[0][0]


def yields_of(spark, last_time, powers):
    rows = [(last_time + QUARTER * (i + 1), 1, "A", float(p)) for i, p in enumerate(powers)]
    df = spark.createDataFrame(rows, "DATE_TIME timestamp_ntz, PLANT_ID int, SOURCE_KEY string, AC_POWER double")
    done = add_yields(df, F.lit(1000.0), F.lit(50.0), F.lit(last_time).cast("timestamp_ntz"))
    return collected(done.select("DATE_TIME", "DAILY_YIELD_forecasted", "TOTAL_YIELD_forecasted"))


def test_daily_yield_goes_on_only_on_the_same_day(spark):
    same = yields_of(spark, datetime(2020, 5, 15, 23, 15), [4, 4, 4, 4])
    assert [r[1] for r in same] == [51.0, 52.0, 1.0, 2.0]
    assert [r[2] for r in same] == [1001.0, 1002.0, 1003.0, 1004.0]
    following = yields_of(spark, datetime(2020, 5, 15, 23, 45), [4, 4])
    assert [r[1] for r in following] == [1.0, 2.0]


def test_no_power_column_gives_zero_yields(spark):
    df = spark.createDataFrame([(datetime(2020, 5, 15), 1, "A", 1.0)], KEYED)
    row = add_yields(df, F.lit(9.0), F.lit(9.0), F.col("DATE_TIME")).first()
    assert row["DAILY_YIELD_forecasted"] == row["TOTAL_YIELD_forecasted"] == 0.0


@pytest.fixture(scope="module")
def history(spark):
    return to_spark(spark, combined_rows(400, seed=5, gaps=0)).cache()


def test_persistence_forecast(spark, history):
    forecast = persistence_forecast(history)
    assert tuple(forecast.columns) == FORECAST_COLUMNS
    counts = forecast.groupBy(*ENTITY).count().collect()
    assert {r["count"] for r in counts} == {HORIZON} and len(counts) == 4
    zero = persistence_forecast(history, persist_power=False)
    assert zero.where("AC_POWER <> 0 or DC_POWER <> 0").isEmpty()
    # Constant yields: the counters stay where history left them.
    assert zero.groupBy(*ENTITY).agg(F.count_distinct("TOTAL_YIELD_forecasted").alias("n")).where("n > 1").isEmpty()
    partial = persistence_weather(history.drop("IRRADIATION"))
    assert partial.where("IRRADIATION <> 0").isEmpty() and not partial.isEmpty()


def test_future_lags_alone_and_with_history(history):
    future = persistence_weather(history).select("DATE_TIME", *ENTITY, *WEATHER)
    alone = future_features(future)
    assert alone.count() == 4 * HORIZON
    # The grid is as long as the longest lag, so that lag is 0 throughout.
    assert alone.where("IRRADIATION_lag_96 <> 0").isEmpty()
    assert not any(c.startswith("AC_POWER") for c in alone.columns)
    joined = future_features(future, history=history)
    assert joined.count() == 4 * HORIZON
    got = joined.where("SOURCE_KEY = 'A'").orderBy("DATE_TIME").select("IRRADIATION_lag_96").toPandas()
    past = history.where("SOURCE_KEY = 'A'").orderBy("DATE_TIME", F.xxhash64(*history.columns)).toPandas()
    assert len(got) == HORIZON and (got["IRRADIATION_lag_96"] != 0).any()
    assert past["IRRADIATION"].tail(HORIZON).sum() == got["IRRADIATION_lag_96"].sum()
    featured = history_features(history)
    assert set(lag_mean_names(WEATHER + POWER)) <= set(featured.columns)
    assert featured.count() == history.count()


def test_long_frame_labels(history):
    forecast = persistence_forecast(history, entities="last")
    frame = long_frame(history, forecast, 20, provided=WEATHER)
    labels = {(r["series"], r["label"]) for r in frame.select("series", "label").distinct().collect()}
    assert ("IRRADIATION", "User-Provided") in labels
    assert ("DAILY_YIELD", "Derived") in labels and ("AC_POWER", "Forecasted") in labels
    assert {s for s, label in labels if label == "Historical"} == {*WEATHER, *POWER, "DAILY_YIELD", "TOTAL_YIELD"}
    sources = history.select("PLANT_ID", "SOURCE_KEY").distinct().count()
    assert frame.where("label = 'Historical'").count() == sources * 20 * 7
    whole = long_frame(history, forecast, 20, provided=WEATHER, by=())
    assert whole.where("label = 'Historical'").count() == 20 * 7
    assert {r["label"] for r in long_frame(history, forecast).select("label").distinct().collect()} == {"Historical", "Forecasted"}
    output = forecast_output(forecast, ["AC_POWER", "absent"])
    assert output.columns == ["DATE_TIME", "PLANT_ID", "SOURCE_KEY", "AC_POWER"]
    times = [r["DATE_TIME"] for r in output.collect()]
    assert times == sorted(times) and len(times) == HORIZON


def test_forecast_of_an_empty_history(spark):
    nothing = spark.createDataFrame([], COMBINED_SCHEMA)
    assert persistence_forecast(nothing).isEmpty()
