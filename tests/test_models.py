"""Groups of trees, rows out of the bag, saved models and forecasts that feed themselves."""

from dataclasses import replace

import numpy as np
import pytest
from helpers import START, sunny_rows
from pyspark.sql import functions as F

from heliodrift.operators.encode import Scaler, fit_entity_encoder
from heliodrift.operators.sequences import lags_and_means
from heliodrift.plans import ensembles, registry
from heliodrift.plans.ensembles import copies, fingerprint, fit_drawn, fit_groups, out_of_bag
from heliodrift.plans.features import history_features, time_features
from heliodrift.plans.forests import (
    CHAIN_PROFILE,
    LAG_PROFILE,
    ModelSet,
    chain_forecast,
    fit_chain,
    fit_lag,
    forecast_chain,
    forecast_lag,
    lag_features,
    lag_forecast,
    out_of_bag_scores,
    train_target,
    training_frame,
)
from heliodrift.plans.recursive import (
    fit_recursive,
    forecast_recursive,
    last_values,
    power_lag_names,
    predict_blocks,
    recursive_features,
    recursive_forecast,
    with_lagged_means,
)
from heliodrift.schemas import COMBINED_SCHEMA, ENTITY, HORIZON, ORDER, POWER, TIME, WEATHER

SMALL = replace(CHAIN_PROFILE, trees=3, depth=5, bins=32)
SMALL_LAG = replace(LAG_PROFILE, trees=3, depth=5, bins=32)


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame(sunny_rows(), COMBINED_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def frame(history):
    return training_frame(time_features(history, cyclical=False))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def vectors(frame):
    from heliodrift.plans.forests import _assembled

    return _assembled(frame, ["hour", "IRRADIATION"], Scaler({}, {})).select(*ORDER, "AC_POWER", "__features")


def test_a_mean_over_groups_is_the_mean_over_trees(frame):
    data = vectors(frame)
    profile = replace(SMALL, trees=5, group_trees=2)
    found = fit_groups(data.drop(*ORDER), "__features", "AC_POWER", profile, threads=3)
    assert [m.getNumTrees for m in found.members] == [2, 2, 1] and found.trees == 5
    row = data.limit(1)
    trees = [t.predict(row.first()["__features"]) for m in found.members for t in m.trees]
    assert found.transform(row).first()["__prediction"] == pytest.approx(np.mean(trees))


def test_fitting_goes_on_after_a_lost_driver(frame, tmp_path, monkeypatch):
    data = vectors(frame).drop(*ORDER)
    profile = replace(SMALL, trees=6, group_trees=2)
    real, fitted, lost = ensembles.regressor, [], [4]

    def counted(profile, features, target, trees, seed):
        if seed - profile.seed in lost:
            raise RuntimeError("the driver is lost")
        fitted.append(seed - profile.seed)
        return real(profile, features, target, trees, seed)

    monkeypatch.setattr(ensembles, "regressor", counted)
    with pytest.raises(RuntimeError):
        fit_groups(data, "__features", "AC_POWER", profile, str(tmp_path))
    assert fitted == [0, 2]
    lost.clear()
    again = fit_groups(data, "__features", "AC_POWER", profile, str(tmp_path))
    assert fitted == [0, 2, 4]
    fresh = fit_groups(data, "__features", "AC_POWER", profile)
    assert rows_of(again.transform(data).select("__prediction")) == rows_of(fresh.transform(data).select("__prediction"))
    fitted.clear()
    fit_groups(data.where("AC_POWER > 0"), "__features", "AC_POWER", profile, str(tmp_path))
    assert fitted == [0, 2, 4]  # other rows: nothing of what is kept fits


def test_a_fingerprint_depends_on_the_rows_alone(frame):
    data = frame.select(*ORDER, "AC_POWER")
    assert fingerprint(data) == fingerprint(data.repartition(7).orderBy("AC_POWER"))
    assert fingerprint(data) != fingerprint(data.where("hour > 0" if "hour" in data.columns else "AC_POWER >= 0").limit(5))


def test_copies_are_poisson_draws_of_the_keys(spark):
    table = spark.range(40_000).select("id", F.lit(None).cast("string").alias("none"))
    drawn = table.select(copies(F.lit(7), ("id", "none")).alias("n"), copies(F.lit(8), ("id", "none")).alias("m"))
    found = drawn.agg(F.avg("n"), F.var_pop("n"), F.avg((F.col("n") == 0).cast("int")), F.corr("n", "m")).first()
    assert found[0] == pytest.approx(1, abs=0.02) and found[1] == pytest.approx(1, abs=0.04)
    assert found[2] == pytest.approx(np.exp(-1), abs=0.01) and abs(found[3]) < 0.02
    assert rows_of(drawn) == rows_of(table.repartition(9).select(copies(F.lit(7), ("id", "none")), copies(F.lit(8), ("id", "none"))))


def test_a_row_is_scored_by_the_trees_that_have_not_seen_it(frame, monkeypatch):
    monkeypatch.setattr(ensembles, "SCORED_TOGETHER", 2)
    data = vectors(frame).checkpoint()
    drawn = fit_drawn(data, "__features", "AC_POWER", replace(SMALL, trees=5), ORDER)
    found = out_of_bag(data, drawn, ORDER).select(*data.columns, "oob_trees", "__prediction", *[copies(F.lit(k), ORDER).alias(f"c{k}") for k in range(5)])
    some_without = False
    for row in found.collect():
        unseen = [m.predict(row["__features"]) for k, m in enumerate(drawn.members) if row[f"c{k}"] == 0]
        assert row["oob_trees"] == len(unseen)
        some_without |= not unseen
        assert row["__prediction"] == (pytest.approx(np.mean(unseen)) if unseen else None)
    assert some_without


def test_out_of_bag_score_beats_the_mean(frame):
    encoder = fit_entity_encoder(frame)
    names = {"DC_POWER": ["hour", *encoder.names], "absent": ["hour"], "AC_POWER": ["absent"]}
    table, scored = out_of_bag_scores(encoder.transform(frame), names, replace(SMALL, trees=8))
    (row,) = table.collect()
    assert row["target"] == "DC_POWER" and row["trees"] == 8 and 0.5 < row["oob_r2"] < 1
    assert row["rows"] == scored["DC_POWER"].where("oob_trees > 0").count() > 700


def test_loaded_models_forecast_as_fresh_ones(spark, history, tmp_path):
    folder = str(tmp_path)
    assert registry.versions(spark, folder) == []
    with pytest.raises(registry.NoModels):
        registry.load(spark, folder)
    chain = fit_chain(history, replace(SMALL, group_trees=2))
    lag = fit_lag(history, SMALL_LAG)
    assert registry.save(spark, chain, folder) == 1 and registry.save(spark, lag, folder) == 2
    # Models without a manifest, as a lost driver leaves them, are no version.
    chain.encoder.vectors.write().save(f"{folder}/models/3/encoder")
    assert registry.versions(spark, folder) == [1, 2]
    old, new = registry.load(spark, folder, 1), registry.load(spark, folder)
    assert (old.kind, new.kind) == ("chain", "lag")
    assert rows_of(forecast_chain(history, old)) == rows_of(forecast_chain(history, chain)) == rows_of(chain_forecast(history, replace(SMALL, group_trees=2)))
    assert rows_of(forecast_lag(history, new)) == rows_of(forecast_lag(history, lag)) == rows_of(lag_forecast(history, profile=SMALL_LAG))
    assert rows_of(registry.feature_table(spark, old)) == rows_of(registry.feature_table(spark, chain))
    assert [m.features for m in old.models.values()] == [m.features for m in chain.models.values()]
    with pytest.raises(registry.NoModels):
        registry.load(spark, folder, 3)


def test_a_set_without_models_is_kept_too(spark, history, tmp_path):
    few = history.orderBy(TIME, *ENTITY).limit(8)
    registry.save(spark, fit_chain(few, SMALL), str(tmp_path))
    loaded = registry.load(spark, str(tmp_path))
    assert loaded.models == {}
    assert {r["AC_POWER"] for r in forecast_chain(few, loaded).collect()} == {0.0}


def test_lags_over_all_series_are_those_of_training(history):
    """With ``by=()`` the grid's lags go by the total order, as the training lags do."""
    fitted = fit_lag(history, SMALL_LAG, by=())
    rows = forecast_lag(history, fitted, by=()).collect()
    assert len(rows) == 2 * HORIZON and all(v is not None for r in rows for v in r)
    assert rows_of(forecast_lag(history, fitted, by=())) == rows_of(lag_forecast(history, profile=SMALL_LAG, by=()))


def test_recursive_lags_are_those_of_the_whole_series(history):
    """Lags computed again over history and forecast equal the ones each block was given."""
    fitted = fit_recursive(history, SMALL_LAG)
    future = forecast_inputs(history, fitted)
    found = predict_blocks(future, last_values(history), fitted.models).checkpoint()
    both = history.select(*ORDER, *POWER).unionByName(found.select(*ORDER, *POWER))
    again = with_lagged_means(lags_and_means(both, POWER, null_free=True))
    names = [n for c in POWER for n in power_lag_names(c)]
    wanted = again.join(found.select(*ORDER), list(ORDER)).select(*ORDER, *names)
    for a, b in zip(rows_of(found.select(*ORDER, *names)), rows_of(wanted), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])
    assert found.count() == 2 * HORIZON


def forecast_inputs(history, fitted):
    from heliodrift.plans.features import future_features
    from heliodrift.plans.persistence import persistence_weather

    return fitted.encoder.transform(future_features(persistence_weather(history), history=history))


def test_recursive_forecast_follows_the_sun(history):
    rows = recursive_forecast(history, replace(SMALL_LAG, trees=5, depth=8)).collect()
    assert len(rows) == 2 * HORIZON and all(v is not None for r in rows for v in r)
    noon, night = ([r["DC_POWER"] for r in rows if r[TIME].hour == h] for h in (12, 1))
    assert min(noon) > max(night) + 300


def test_recursive_forecast_of_short_series_and_without_models(spark, history):
    few = history.where(F.col(TIME) < F.lit(START) + F.expr("INTERVAL 2 HOURS"))  # eight rows a series
    fitted = fit_recursive(history, SMALL_LAG)
    rows = forecast_recursive(few, fitted).collect()
    assert len(rows) == 2 * HORIZON and all(v is not None for r in rows for v in r)
    nothing = forecast_recursive(few, ModelSet("recursive", {}, fitted.encoder)).collect()
    assert {(r["DC_POWER"], r["AC_POWER"]) for r in nothing} == {(0.0, 0.0)}


def test_recursive_features_hold_nothing_that_is_to_be_predicted():
    names = recursive_features(["PLANT_vector"])
    assert "DC_POWER_roll_mean_12" not in names["DC_POWER"] and "AC_POWER_lag_4" not in names["DC_POWER"]
    assert {"DC_POWER", "AC_POWER_roll_mean_12_lag_4", "DC_POWER_lag_96"} <= set(names["AC_POWER"])
    assert set(lag_features([])["DC_POWER"]) >= {"DC_POWER_roll_mean_12"}


def test_training_frames_have_every_recursive_feature(history):
    frame = with_lagged_means(history_features(history))
    encoded = fit_entity_encoder(frame).transform(frame)
    for names in recursive_features(["PLANT_vector", "SOURCE_vector"]).values():
        assert set(names) <= set(encoded.columns)
    assert train_target(frame, "AC_POWER", ("absent",), SMALL) is None
    assert set(WEATHER) <= set(frame.columns)
