"""Order-dependent operators against pandas, in every layout."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from helpers import combined_rows, to_spark

from heliodrift.operators.layout import CELLS, choose_cell, lay_out
from heliodrift.operators.sequences import (
    fill,
    lag_mean_names,
    lags_and_means,
    row_numbers,
    running_total,
)
from heliodrift.plans.clean import fill_measures
from heliodrift.schemas import COMBINED_SCHEMA, ENTITY, MEASURES, ORDER, WEATHER

TIED = (*ORDER, "DAILY_YIELD")
ROWS = 600
LAYOUTS = [
    (by, cell)
    for by in ((), ENTITY)
    for cell in (*CELLS, "RANGE")
    if by or cell != "WHOLE"
]


@pytest.fixture(scope="module")
def table():
    return combined_rows(ROWS)


@pytest.fixture(scope="module")
def frame(spark, table):
    shuffled = table.sample(frac=1, random_state=7)
    return to_spark(spark, shuffled).repartition(5).cache()


def sorted_pandas(df):
    return df.toPandas().sort_values(list(TIED)).reset_index(drop=True)


def per_series(table, by, make):
    if not by:
        return make(table)
    parts = [make(part) for _, part in table.groupby(list(by))]
    return pd.concat(parts).sort_index()


def check(result, expected, columns):
    got = sorted_pandas(result)
    assert len(got) == len(expected)
    for column in columns:
        np.testing.assert_allclose(
            got[column].astype(float), expected[column].astype(float), err_msg=column
        )


@pytest.mark.parametrize("by,cell", LAYOUTS)
def test_row_numbers(frame, table, by, cell):
    result = row_numbers(frame, "n", by, TIED, max_rows=50, cell=cell)
    expected = per_series(table, by, lambda t: t.assign(n=range(1, len(t) + 1)))
    check(result, expected, ["n"])


@pytest.mark.parametrize("by,cell", LAYOUTS)
def test_running_total(frame, table, by, cell):
    result = running_total(
        frame, "DAILY_YIELD", "total", by, TIED, seed=5.0, max_rows=50, cell=cell
    )
    expected = per_series(table, by, lambda t: t.assign(total=5 + t["DAILY_YIELD"].cumsum()))
    check(result, expected, ["total"])


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("by,cell", LAYOUTS)
def test_fill(frame, table, by, cell, direction):
    def filled(t):
        done = t[list(WEATHER)]
        done = done.ffill().bfill() if direction == "forward" else done.bfill().ffill()
        return t.assign(**{c: done[c] for c in WEATHER})

    result = fill(frame, WEATHER, by, TIED, direction, max_rows=50, cell=cell)
    check(result, per_series(table, by, filled), WEATHER)


def with_lags(table):
    made = {}
    for c in WEATHER:
        made[f"{c}_lag_4"] = table[c].shift(4)
        made[f"{c}_lag_96"] = table[c].shift(96)
        made[f"{c}_roll_mean_12"] = table[c].rolling(12, min_periods=1).mean()
    made = pd.DataFrame(made, index=table.index).bfill().ffill().fillna(0)
    return table.assign(**made)


@pytest.mark.parametrize("by,cell", LAYOUTS)
def test_lags_with_gaps(frame, table, by, cell):
    result = lags_and_means(frame, WEATHER, by, TIED, max_rows=50, cell=cell)
    check(result, per_series(table, by, with_lags), lag_mean_names(WEATHER))


@pytest.mark.parametrize("by,cell", LAYOUTS)
def test_lags_of_filled_columns(spark, by, cell):
    # D has fewer rows than the longer lag.
    table = combined_rows(ROWS, seed=1, gaps=0)
    result = lags_and_means(
        to_spark(spark, table), WEATHER, by, TIED, null_free=True, max_rows=50, cell=cell
    )
    check(result, per_series(table, by, with_lags), lag_mean_names(WEATHER))


@pytest.mark.parametrize("by,cell", LAYOUTS)
def test_fill_then_lags_on_its_numbers(frame, table, by, cell):
    """Rows without keys lend values, then go; the lags only see those that stay."""
    keyless = F.col("DAILY_YIELD") % 7 == 3
    holed = frame.withColumn("PLANT_ID", F.when(~keyless, F.col("PLANT_ID")))
    options = {"max_rows": 50, "cell": cell}
    filled = fill_measures(holed, WEATHER, by, TIED, number="n", **options)
    result = lags_and_means(filled, WEATHER, by, null_free=True, number="n", **options)
    gone = table["DAILY_YIELD"] % 7 == 3
    holes = table.assign(PLANT_ID=table["PLANT_ID"].where(~gone))
    # Keyless rows form series of their own, or lend to all when there is one.
    holes = holes.sort_values(list(TIED), na_position="first").reset_index(drop=True)

    def expected(t):
        done = t.assign(**t[list(WEATHER)].ffill().bfill().fillna(0))
        return done.dropna(subset=["PLANT_ID"])

    if by:
        kept = holes.dropna(subset=["PLANT_ID"])
        kept = per_series(kept, by, lambda t: with_lags(expected(t)))
    else:
        kept = with_lags(expected(holes))
    check(result, kept.sort_values(list(TIED)).reset_index(drop=True), lag_mean_names(WEATHER))


def test_exactly_as_many_rows_as_the_lag(spark):
    table = combined_rows(96, seed=2, gaps=0)
    for null_free in (True, False):
        result = lags_and_means(
            to_spark(spark, table), WEATHER, (), TIED, null_free=null_free, max_rows=10
        )
        got = sorted_pandas(result)
        assert (got["IRRADIATION_lag_96"] == 0).all()
        assert (got["IRRADIATION_lag_4"][:5] == table["IRRADIATION"][0]).all()


def test_cell_is_the_coarsest_that_fits(frame):
    assert choose_cell(frame, ENTITY, ("DATE_TIME",), 10**6) == "WHOLE"
    assert choose_cell(frame, (), ORDER, 10**6) == "DAY"
    # A third of all rows share one timestamp: no calendar cell is small enough.
    assert choose_cell(frame, (), ORDER, 50) == "RANGE"
    assert choose_cell(frame, ENTITY, ("DATE_TIME",), 50) == "RANGE"


def test_one_global_series_is_never_one_window(frame):
    assert choose_cell(frame.limit(3), (), ORDER, 10**6) != "WHOLE"


def test_range_segments_split_a_hot_timestamp(frame):
    layout = lay_out(frame, (), TIED, max_rows=50)
    counts = layout.frame.groupBy("__segment").count().toPandas()["count"]
    assert layout.cell == "RANGE" and len(counts) > 8 and counts.max() < 200


def test_copies_are_split_too(spark):
    # All rows equal: only the row number can part them.
    table = combined_rows(1, gaps=0)
    copies = to_spark(spark, pd.concat([table] * 400))
    layout = lay_out(copies, ENTITY, max_rows=50)
    counts = layout.frame.groupBy("__segment").count().toPandas()["count"]
    assert counts.sum() == 400 and counts.max() < 200
    numbered = row_numbers(copies, "n", ENTITY, max_rows=50).toPandas()["n"]
    assert sorted(numbered) == list(range(1, 401))


@pytest.mark.parametrize("partitions", ["1", "8", "64"])
def test_result_does_not_depend_on_partitions(spark, frame, table, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        result = fill(frame.repartition(13, "IRRADIATION"), WEATHER, (), TIED, cell="DAY")
        filled = table.assign(**table[list(WEATHER)].ffill().bfill())
        check(result, filled, WEATHER)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ties_are_settled_by_content(spark, table):
    # Without a tie column in the order, shuffled input still gives one result.
    results = []
    for seed in (1, 2):
        df = to_spark(spark, table.sample(frac=1, random_state=seed)).repartition(seed + 2)
        results.append(sorted_pandas(fill(df, WEATHER, (), ORDER, cell="HOUR")))
    pd.testing.assert_frame_equal(*results)


def test_all_null_column_and_empty_frame(spark, table):
    empty_column = to_spark(spark, table.assign(IRRADIATION=np.nan))
    filled = fill_measures(empty_column)
    assert filled.where("IRRADIATION <> 0").isEmpty()
    nothing = spark.createDataFrame([], COMBINED_SCHEMA)
    for by in ((), ENTITY):
        assert fill_measures(nothing, by=by).isEmpty()
        assert lags_and_means(nothing, WEATHER, by).isEmpty()


def test_null_series_keys_keep_their_own_series(spark):
    rows = [
        (pd.Timestamp(2020, 1, d).to_pydatetime(), 1, None, *([v] * 7))
        for d, v in ((1, 3.0), (2, None), (9, None))
    ]
    df = spark.createDataFrame(rows, COMBINED_SCHEMA)
    for cell in ("WHOLE", "DAY"):
        values = fill(df, ["DC_POWER"], cell=cell).collect()
        assert [row["DC_POWER"] for row in values] == [3.0] * 3


def test_rows_without_keys_lend_their_values(spark):
    rows = [
        (pd.Timestamp(2020, 1, 1).to_pydatetime(), 1, None, *([7.0] * 7)),
        (pd.Timestamp(2020, 1, 2).to_pydatetime(), 1, "A", *([None] * 7)),
    ]
    df = spark.createDataFrame(rows, COMBINED_SCHEMA)
    (row,) = fill_measures(df, by=()).collect()
    assert [row[c] for c in MEASURES] == [7.0] * 7
    (row,) = fill_measures(df).collect()
    assert [row[c] for c in MEASURES] == [0.0] * 7


def test_no_window_over_readings_is_unpartitioned(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "readings"))
    stored = spark.read.parquet(str(tmp_path / "readings"))
    filled = fill(stored, WEATHER, (), ORDER)
    plan = lags_and_means(filled, WEATHER, (), ORDER, null_free=True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    for line in text.splitlines():
        if "Window [" in line and "lag(" in line:
            assert "windowspecdefinition(__group" in line
        if "Window [last(" in line and "__last" not in line:
            assert "windowspecdefinition(__group" in line
