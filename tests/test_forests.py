"""Forest chains on a signal that can be learnt."""

from datetime import datetime, timedelta
from dataclasses import replace

import numpy as np
import pytest

from heliodrift.operators.spine import future_spine
from heliodrift.plans.forests import (
    CHAIN_PROFILE,
    DEPENDENCY_ORDER,
    LAG_PROFILE,
    LISTED_ORDER,
    chain_features,
    chain_forecast,
    holdout_r2,
    lag_features,
    lag_forecast,
    predict_chain,
    train_chain,
    train_target,
    training_frame,
)
from heliodrift.plans.features import time_features
from heliodrift.schemas import COMBINED_SCHEMA, ENTITY, HORIZON, WEATHER

SMALL = replace(CHAIN_PROFILE, trees=3, depth=5, bins=32)


@pytest.fixture(scope="module")
def history(spark):
    """Four days of two plants with a sun that rises and sets."""
    rng = np.random.default_rng(0)
    rows = []
    for step in range(4 * 96):
        time = datetime(2020, 5, 15) + timedelta(minutes=15 * step)
        sun = max(0.0, float(np.sin(2 * np.pi * (time.hour + time.minute / 60 - 6) / 24)))
        for plant, source in ((1, "A"), (2, "B")):
            ambient = 20 + 5 * sun + rng.normal() * 0.1
            module = ambient + 20 * sun
            dc = 1000 * plant * sun
            rows.append(
                (time, plant, source, dc, dc * 0.96, float(step % 96), 1e5 + step, ambient, module, sun)
            )
    return spark.createDataFrame(rows, COMBINED_SCHEMA).repartition(3).cache()


def check(forecast, series=2):
    rows = forecast.collect()
    assert len(rows) == series * HORIZON
    assert all(v is not None for r in rows for v in r)
    assert all(r[c] >= 0 for r in rows for c in ("IRRADIATION", "DC_POWER", "AC_POWER"))
    for key in {(r["PLANT_ID"], r["SOURCE_KEY"]) for r in rows}:
        mine = sorted(r for r in rows if (r["PLANT_ID"], r["SOURCE_KEY"]) == key)
        totals = [r["TOTAL_YIELD_forecasted"] for r in mine]
        assert totals == sorted(totals)
    return rows


def test_chain_forecast_follows_the_sun_and_repeats(history):
    first = sorted(check(chain_forecast(history, SMALL)))
    noon = [r for r in first if r["DATE_TIME"].hour == 12]
    night = [r for r in first if r["DATE_TIME"].hour == 1]
    assert min(r["DC_POWER"] for r in noon) > max(r["DC_POWER"] for r in night) + 100
    again = sorted(check(chain_forecast(history.repartition(5), SMALL)))
    assert first == again


def test_plants_are_told_apart(history):
    rows = check(chain_forecast(history, SMALL))
    noon = {r["PLANT_ID"]: r["DC_POWER"] for r in rows if r["DATE_TIME"].hour == 12}
    assert noon[2] > noon[1] + 300


def test_listed_order_sees_no_irradiation_for_the_module(history):
    frame = training_frame(time_features(history, cyclical=False))
    models = train_chain(frame, chain_features(()), SMALL)
    assert tuple(models) == DEPENDENCY_ORDER
    future = time_features(future_spine(history), cyclical=False)
    listed = predict_chain(future, models, LISTED_ORDER).toPandas()
    ordered = predict_chain(future, models).toPandas()
    # With irradiation 0 the module is taken for cold at noon.
    assert listed["MODULE_TEMPERATURE"].max() < ordered["MODULE_TEMPERATURE"].max() - 5


def test_lag_forecast_with_given_weather(history):
    small = replace(LAG_PROFILE, trees=3, depth=5, bins=32)
    weather = future_spine(history).selectExpr(
        "DATE_TIME", *[f"cast(0 as double) as {c}" for c in WEATHER]
    )
    dark = check(lag_forecast(history, weather, small))
    assert {r["IRRADIATION"] for r in dark} == {0.0}
    check(lag_forecast(history, profile=small, entities="last", with_history=True), series=1)


def test_feature_lists():
    assert chain_features(["PLANT_1"])["AMBIENT_TEMPERATURE"][-1] == "PLANT_1"
    assert chain_features([])["AC_POWER"][-4:] == ["DC_POWER", *WEATHER]
    power = lag_features([])
    assert "AC_POWER_lag_4" not in power["DC_POWER"] and "AC_POWER_lag_4" in power["AC_POWER"]
    assert "DC_POWER" in power["AC_POWER"] and "DC_POWER_roll_mean_12" in power["AC_POWER"]


def test_too_few_rows_or_columns_give_no_model(history):
    assert train_target(history.limit(9), "AC_POWER", ["DC_POWER"], SMALL) is None
    assert train_target(history, "absent", ["DC_POWER"], SMALL) is None
    assert train_target(history, "AC_POWER", ["absent"], SMALL) is None
    assert train_target(history.limit(10), "AC_POWER", ["DC_POWER"], SMALL) is not None


def test_forecast_without_a_model_persists_weather(history):
    few = history.orderBy("DATE_TIME", *ENTITY).limit(8)
    forecast = chain_forecast(few, SMALL)
    rows = forecast.collect()
    assert len(rows) == 2 * HORIZON
    assert {r["AC_POWER"] for r in rows} == {0.0}
    assert all(r["AMBIENT_TEMPERATURE"] > 19 for r in rows)


def test_hold_out_beats_the_mean(history):
    scores = {r["target"]: r for r in holdout_r2(history, SMALL).collect()}
    assert set(scores) == set(DEPENDENCY_ORDER)
    assert all(r["holdout_r2"] > 0.5 for r in scores.values())
    row = scores["AC_POWER"]
    assert row["train_rows"] + row["test_rows"] == 2 * 4 * 96 and row["test_rows"] > 50
