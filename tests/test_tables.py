"""Joins, de-duplication, aggregations, statistics, encodings."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from helpers import collected, combined_rows, to_spark
from pyspark.sql import functions as F

from heliodrift.operators import columns as C
from heliodrift.operators.combine import (
    DuplicateTimes,
    align_to_spine,
    drop_duplicates,
    join_weather,
    union_plants,
)
from heliodrift.operators.describe import QUARTILES, describe, exact_quantiles
from heliodrift.operators.encode import (
    TooManyValues,
    category_map,
    dummy_names,
    fit_scaler,
    one_hot,
    scalable_columns,
    sparse_one_hot,
)
from heliodrift.operators.profile import (
    at_latest,
    daily_totals,
    distinct_counts,
    first_rows,
    head,
    first_at_latest,
    last_rows,
    over_two_values,
    sum_per_timestamp,
    tail,
)
from heliodrift.plans.clean import clean
from heliodrift.schemas import (
    COMBINED_SCHEMA,
    ENTITY,
    GENERATION_SCHEMA,
    WEATHER_SCHEMA,
)

T0, T1 = datetime(2020, 5, 15), datetime(2020, 5, 15, 0, 15)


def test_null_keys_match_and_duplicates_fan_out(spark):
    gen = spark.createDataFrame(
        [(T0, 1, "A", 1.0, 1.0, 1.0, 1.0), (T0, None, "B", 2.0, 2.0, 2.0, 2.0), (T1, 1, "C", 3.0, 3.0, 3.0, 3.0)],
        GENERATION_SCHEMA,
    )
    wx = spark.createDataFrame(
        [(T0, 1, 10.0, 20.0, 0.1), (T0, 1, 11.0, 21.0, 0.2), (T0, None, 12.0, 22.0, 0.3)],
        WEATHER_SCHEMA,
    )
    joined = join_weather(gen, wx)
    assert sorted(joined.columns) == sorted(COMBINED_SCHEMA.fieldNames())
    found = collected(joined.select("SOURCE_KEY", "AMBIENT_TEMPERATURE"))
    assert found == [("A", 10.0), ("A", 11.0), ("B", 12.0), ("C", None)]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_hot_join_key_with_and_without_broadcast(spark, threshold):
    rows = [(T0, 1, f"S{i}", float(i), 0.0, 0.0, 0.0) for i in range(500)]
    gen = spark.createDataFrame([*rows, (T1, 2, "Z", 1.0, 0.0, 0.0, 0.0)], GENERATION_SCHEMA)
    wx = spark.createDataFrame([(T0, 1, 1.0, 2.0, 3.0)], WEATHER_SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        joined = join_weather(gen, wx)
        assert joined.count() == 501
        assert joined.where("AMBIENT_TEMPERATURE is null").count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_union_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, 2.0)], "PLANT_ID int, x double")
    b = spark.createDataFrame([(3.0, 4)], "y double, PLANT_ID int")
    assert collected(union_plants(a, b).select("PLANT_ID", "x", "y"), "PLANT_ID") == [(1, 2.0, None), (4, None, 3.0)]


def test_duplicates_with_and_without_time(spark):
    rows = [(T1, 1, "A", 5.0), (T0, 1, "A", 5.0), (T0, 1, "A", 5.0), (T0, 1, "A", None), (T1, 1, "A", None)]
    df = spark.createDataFrame(rows, "DATE_TIME timestamp_ntz, PLANT_ID int, SOURCE_KEY string, AC_POWER double")
    assert drop_duplicates(df).count() == 4
    assert collected(drop_duplicates(df, include_time=False)) == [(T0, 1, "A", None), (T0, 1, "A", 5.0)]


def test_alignment_rejects_repeated_times(spark):
    spine = spark.createDataFrame([(T0,), (T1,)], "DATE_TIME timestamp_ntz")
    values = spark.createDataFrame([(T1, 1.0), (datetime(2021, 1, 1), 2.0)], "DATE_TIME timestamp_ntz, v double")
    assert collected(align_to_spine(spine, values)) == [(T0, None), (T1, 1.0)]
    with pytest.raises(DuplicateTimes):
        align_to_spine(spine, values.union(values))


def test_sums(spark):
    rows = [(T0, 1, "A", None, 1.0, 1.0, 1.0), (T0, 1, "B", None, 2.0, 1.0, 1.0), (None, 1, "B", 9.0, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, GENERATION_SCHEMA)
    # All-null sums to 0, rows without a time are left out.
    assert collected(sum_per_timestamp(df)) == [(T0, 0.0, 3.0, 2.0, 2.0)]
    assert collected(daily_totals(df)) == [(T0.date(), 0.0, 3.0, 2.0, 2.0)]


def test_first_and_last_rows(spark):
    table = combined_rows(200, seed=3)
    df = to_spark(spark, table)
    last = last_rows(df, ()).first()
    assert last["DATE_TIME"] == table["DATE_TIME"].max()
    assert at_latest(df).count() == (table["DATE_TIME"] == table["DATE_TIME"].max()).sum()
    expected = table.groupby(["PLANT_ID", "SOURCE_KEY"])["DATE_TIME"].max()
    found = {(r["PLANT_ID"], r["SOURCE_KEY"]): r["DATE_TIME"] for r in last_rows(df).collect()}
    assert found == expected.to_dict()
    assert first_rows(df, ()).first()["DATE_TIME"] == table["DATE_TIME"].min()
    assert first_at_latest(df).first() == first_rows(at_latest(df), ()).first()
    assert first_at_latest(df.where("false")).isEmpty()
    nothing = spark.createDataFrame([], COMBINED_SCHEMA)
    assert last_rows(nothing, ()).isEmpty() and at_latest(nothing).isEmpty()
    assert [r["DATE_TIME"] for r in head(df, 5).collect()] == list(table["DATE_TIME"][:5])
    assert sorted(r["DATE_TIME"] for r in tail(df, 7).collect()) == list(table["DATE_TIME"][-7:])


def test_more_than_two_values(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 1.0, None), (2.0, 2.0, 1.0, None), (3.0, None, 1.0, None)],
        "three double, two double, one double, none double",
    )
    names = df.columns
    assert over_two_values(df, names) == {
        "three": (True, True), "two": (False, True), "one": (False, False), "none": (False, False),
    }
    counts = {r["column"]: (r["distinct_values"], r["distinct_with_null"]) for r in distinct_counts(df, names).collect()}
    assert counts == {"three": (3, 3), "two": (2, 3), "one": (1, 1), "none": (0, 1)}


@pytest.mark.parametrize("max_ranked", [3, 40, 10**6])
def test_quartiles_are_exact(spark, max_ranked):
    rng = np.random.default_rng(0)
    table = pd.DataFrame(
        {
            "smooth": rng.normal(size=997),
            # One value holds most rows, and two values hold all.
            "hot": np.where(rng.random(997) < 0.6, 7.0, rng.normal(size=997) * 1e6),
            "pair": np.where(np.arange(997) % 2 == 0, 1.0, 2.0),
            "wide": 10.0 ** rng.integers(-300, 300, 997),
            "gappy": np.where(rng.random(997) < 0.5, np.nan, rng.normal(size=997)),
            "flat": 3.0,
        }
    )
    schema = ", ".join(f"{c} double" for c in table)
    df = to_spark(spark, table, schema).cache()
    found = exact_quantiles(df, list(table), QUARTILES, max_ranked)
    for c in table:
        np.testing.assert_allclose(found[c], table[c].quantile(list(QUARTILES)), rtol=1e-12)
    rows = {r["column"]: r for r in describe(df, list(table), max_ranked).collect()}
    expected = table.describe()
    for c in table.columns.drop("wide"):
        got = [rows[c][k] for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]
        np.testing.assert_allclose(got, expected[c], rtol=1e-9, atol=1e-12)


def test_quartiles_of_nothing(spark):
    df = spark.createDataFrame([], COMBINED_SCHEMA)
    assert exact_quantiles(df, ["AC_POWER"], QUARTILES, 1) == {"AC_POWER": [None] * 3}
    assert {r["count"] for r in describe(df).collect()} == {0}


def test_one_hot_dense_and_sparse_agree(spark):
    rows = [(1, "B"), (2, "A"), (None, "B"), (2, None)]
    df = spark.createDataFrame(rows, "PLANT_ID int, SOURCE_KEY string")
    categories = category_map(df)
    names = ["PLANT_1", "PLANT_2", "SOURCE_A", "SOURCE_B"]
    assert dummy_names(categories) == names
    dense = one_hot(df, categories).select("PLANT_ID", "SOURCE_KEY", *names)
    text = df.withColumn("PLANT_ID", F.col("PLANT_ID").cast("string"))
    sparse = sparse_one_hot().fit(text).transform(text)
    wanted = {tuple(r)[:2]: list(r)[2:] for r in dense.collect()}
    for row in sparse.collect():
        key = (int(row["PLANT_ID"]) if row["PLANT_ID"] else None, row["SOURCE_KEY"])
        assert [*row["PLANT_vector"].toArray(), *row["SOURCE_vector"].toArray()] == wanted[key]
    assert wanted[None, "B"] == [0.0, 0.0, 0.0, 1.0]
    with pytest.raises(TooManyValues):
        category_map(df, max_values=1)


def test_scaler_uses_the_population_deviation(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0, 5.0, 0.1, True), (2.0, 1.0, 5.0, 0.2, True), (6.0, 0.0, 5.0, 0.3, False)],
        "x double, PLANT_1 double, flat double, t_sin double, dummy boolean",
    )
    assert scalable_columns(df, df.columns) == ["x", "t_sin"]
    assert scalable_columns(df, df.columns, skip_cyclical=True) == ["x"]
    scaled = fit_scaler(df, ["x", "flat"]).transform(df).toPandas()
    x = np.array([1.0, 2.0, 6.0])
    np.testing.assert_allclose(scaled["x"], (x - x.mean()) / x.std())
    assert list(scaled["flat"]) == [0.0] * 3


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, "a", 2.0, True)], "hour int, PLANT_x string, v_lag_4 double, flag boolean")
    assert C.with_prefix(df, "PLANT_", "hour") == ["hour", "PLANT_x"]
    assert C.with_suffix(df, "_4") == ["v_lag_4"]
    assert C.containing(df, "_lag_", "_roll_") == ["v_lag_4"]
    assert C.numeric_columns(df) == ["hour", "v_lag_4"]
    assert C.existing(df, ["z", "v_lag_4", "hour"]) == ["hour", "v_lag_4"]
    assert C.add_missing(df, ["hour", "z"]).first()["z"] == 0.0
    assert C.has_at_least(df, 1) and not C.has_at_least(df, 2)
    assert C.strip_forecast_suffix("DAILY_YIELD_forecasted") == "DAILY_YIELD"
    with pytest.warns(UserWarning, match="z"):
        assert C.check_columns(df, ["hour", "z"], strict=False) == ["hour"]
    with pytest.raises(C.MissingColumns):
        C.check_columns(df, ["z"])
    with pytest.raises(ValueError):
        C.require_rows(df.where("false"))
    assert C.require_rows(df) is df


def test_clean_from_text(spark):
    rows = [
        ("15-05-2020 00:00", 1, "A", None, "x"),
        ("15-05-2020 00:15", 1, "A", 2.0, "3"),
        ("15-05-2020 00:15", 1, "A", 2.0, "3"),
        ("junk", 1, "A", 9.0, "9"),
        ("2020-05-15 00:30:00", 1, None, 8.0, "8"),
        ("2020-05-15 00:45:00", 1, "A", None, None),
    ]
    df = spark.createDataFrame(rows, "DATE_TIME string, PLANT_ID int, SOURCE_KEY string, DC_POWER double, AC_POWER string")
    with pytest.warns(UserWarning):
        done = clean(df, by=()).select("DATE_TIME", "DC_POWER", "AC_POWER")
    # Text that is no number becomes 0, not its neighbour's value.
    assert collected(done) == [
        (T0, 2.0, 0.0), (T1, 2.0, 3.0), (datetime(2020, 5, 15, 0, 45), 8.0, 8.0),
    ]
    with pytest.warns(UserWarning):
        per_source = clean(df, by=ENTITY).select("DATE_TIME", "DC_POWER", "AC_POWER")
    assert collected(per_source)[-1] == (datetime(2020, 5, 15, 0, 45), 2.0, 3.0)
