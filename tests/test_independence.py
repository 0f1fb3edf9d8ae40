"""Results do not depend on data size, splits, partitions or session settings."""

import math
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from heliodrift.operators.columns import numeric_columns
from heliodrift.operators.describe import describe
from heliodrift.operators.encode import category_map, fit_entity_encoder
from heliodrift.operators.profile import (
    distinct_counts,
    head,
    null_profile,
    tail,
    tail_per_series,
)
from heliodrift.operators.sequences import running_total
from heliodrift.plans.clean import clean
from heliodrift.plans.forests import CHAIN_PROFILE, train_target, training_frame, training_parts
from heliodrift.schemas import GENERATION_SCHEMA
from heliodrift.sources.csv_files import read_generation, read_readings

READINGS = "DATE_TIME timestamp_ntz, PLANT_ID int, SOURCE_KEY string, AC_POWER double"


def readings(spark, values, key="A"):
    rows = spark.createDataFrame(list(enumerate(values)), "n int, AC_POWER double")
    return rows.select(
        F.expr("timestampadd(HOUR, n * 7, timestamp_ntz'2024-01-01')").alias("DATE_TIME"),
        F.lit(1).alias("PLANT_ID"),
        F.lit(key).alias("SOURCE_KEY"),
        "AC_POWER",
    )


@pytest.mark.parametrize("cell", ["WHOLE", "DAY", "HOUR", "RANGE"])
def test_running_total_starts_at_its_seed_under_every_split(spark, cell):
    df = readings(spark, [None, None, 2.0, None, 3.0])
    rows = running_total(df, "AC_POWER", "t", seed=10.0, cell=cell, max_rows=2).orderBy("DATE_TIME")
    assert [r["t"] for r in rows.collect()] == [10, 10, 12, 12, 15]


@pytest.mark.parametrize("max_ranked", [3, 1_000])
def test_describe_is_the_same_on_both_ways(spark, max_ranked):
    inf, nan = math.inf, math.nan
    rows = [(x, Decimal(k), k) for k, x in enumerate([inf, -inf, 1.0, nan, inf, 2.0, inf, None, inf])]
    df = spark.createDataFrame(rows, "x double, d decimal(10,2), k int")
    found = {r["column"]: r for r in describe(df, ("x", "d", "k"), max_ranked).collect()}
    assert found["x"]["count"] == 7 and (found["x"]["p25"], found["x"]["p50"], found["x"]["p75"]) == (1.5, inf, inf)
    assert [found[c]["p50"] for c in ("d", "k")] == [4.0, 4.0] and found["d"]["max"] == 8


def test_ties_of_first_and_last_rows_do_not_depend_on_partitions(spark):
    rows = readings(spark, [1.0]).crossJoin(spark.range(6).withColumnRenamed("id", "x"))
    for pick in (head, tail):
        found = {tuple(r["x"] for r in pick(rows.repartition(n), 2).collect()) for n in (1, 3, 5)}
        assert len(found) == 1


def test_tail_is_in_order_and_per_series_for_each_source(spark):
    df = readings(spark, [float(k) for k in range(9)]).unionByName(readings(spark, [7.0, 8.0], "B"))
    assert [r["AC_POWER"] for r in tail(df.where("SOURCE_KEY = 'A'"), 3).collect()] == [6, 7, 8]
    found = tail_per_series(df, 3).groupBy("SOURCE_KEY").agg(F.sort_array(F.collect_list("AC_POWER")).alias("v"))
    assert {r["SOURCE_KEY"]: r["v"] for r in found.collect()} == {"A": [6, 7, 8], "B": [7, 8]}


def test_distinct_values_keep_their_type(spark):
    rows = [(2**53, "a", 1.0), (2**53 + 1, "b", math.nan), (2**53, None, -0.0), (None, "a", 0.0)]
    df = spark.createDataFrame(rows, "n long, s string, x double")
    found = {r["column"]: tuple(r)[1:] for r in distinct_counts(df, ["n", "s", "x"]).collect()}
    assert found == {"n": (2, 3), "s": (2, 3), "x": (2, 3)}


def test_nan_is_missing(spark):
    df = readings(spark, [5.0, math.nan, 7.0])
    assert [r["AC_POWER"] for r in clean(df).orderBy("DATE_TIME").collect()] == [5, 5, 7]
    (row,) = null_profile(df, ["AC_POWER"]).collect()
    assert row["null_count"] == 1 and row["any_null"]


def test_an_empty_history_is_refused_when_guarded(spark):
    with pytest.raises(ValueError, match="no rows left"):
        clean(readings(spark, []), guard=True)


def test_more_than_a_thousand_sources_keep_their_names_and_slots(spark):
    df = spark.range(1_200).select(
        F.lit(1).alias("PLANT_ID"), F.format_string("S%04d", "id").alias("SOURCE_KEY")
    )
    assert len(category_map(df)["SOURCE_KEY"]) == 1_200
    few, many = fit_entity_encoder(df.limit(3)), fit_entity_encoder(df)
    assert few.names == many.names
    row = many.transform(df.where("SOURCE_KEY = 'S0777'")).first()
    assert row["SOURCE_vector"].indices.tolist() == [777]


def test_training_partitions_follow_the_rows_alone(spark):
    assert [training_parts(n) for n in (0, 999, 1_001, 10**6, 10**9)] == [1, 1, 2, 64, 5_000]
    df = readings(spark, [float(k % 13) for k in range(2_500)]).withColumn("hour", F.hour("DATE_TIME"))
    small = replace(CHAIN_PROFILE, trees=3, depth=4)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), set()
    try:
        for setting in ("1", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", setting)
            frame = training_frame(df)
            assert "AC_POWER" in numeric_columns(frame)
            model = train_target(frame, "AC_POWER", ["hour"], small)
            cells = spark.range(24).select(F.col("id").cast("int").alias("hour"))
            found.add(tuple(r["AC_POWER"] for r in model.predict(cells).orderBy("hour").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 1


HEADER = ["DATE_TIME", "PLANT_ID", "SOURCE_KEY", "DC_POWER", "AC_POWER", "DAILY_YIELD", "TOTAL_YIELD"]


def write(path, columns, values):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join([",".join(columns), ",".join(str(values[c]) for c in columns)]) + "\n")


def test_headers_of_a_folder_are_checked_or_united(spark, tmp_path):
    values = dict(zip(HEADER, ["2024-01-01 00:00:00", 1, "A", 10.0, 20.0, 30.0, 40.0], strict=True))
    swapped = [*HEADER[:3], "AC_POWER", "DC_POWER", *HEADER[5:]]
    write(tmp_path / "g" / "1.csv", HEADER, values)
    write(tmp_path / "g" / "2.csv", swapped, values | {"SOURCE_KEY": "B"})
    with pytest.raises(Exception, match="FAILED_READ_FILE|header"):
        read_generation(spark, str(tmp_path / "g")).collect()
    files = [str(tmp_path / "g" / f) for f in ("1.csv", "2.csv")]
    for paths, mixed in ((str(tmp_path / "g"), True), (files, False)):
        rows = read_readings(spark, paths, GENERATION_SCHEMA, mixed=mixed).collect()
        assert {(r["SOURCE_KEY"], r["DC_POWER"], r["AC_POWER"]) for r in rows} == {("A", 10, 20), ("B", 10, 20)}


def test_many_files_of_one_header_are_one_scan(spark, tmp_path):
    values = dict(zip(HEADER, ["2024-01-01 00:00:00", 1, "A", 1.0, 2.0, 3.0, 4.0], strict=True))
    for k in range(30):
        write(tmp_path / "m" / f"{k}.csv", HEADER, values)
    df = read_generation(spark, [str(tmp_path / "m" / f"{k}.csv") for k in range(30)])
    assert df.count() == 30 and df._jdf.queryExecution().toString().count("FileScan csv") == 1


def test_unreadable_numbers_become_zero_after_the_fill(spark, tmp_path):
    (tmp_path / "u.csv").write_text(
        ",".join(HEADER) + "\n" + "".join(f"2024-01-01 0{k}:00:00,1,A,1,{x},1,1\n" for k, x in enumerate(("5", "x", "", "7")))
    )
    raw = read_generation(spark, str(tmp_path / "u.csv"), raw=True)
    rows = clean(raw).orderBy("DATE_TIME").collect()
    assert [r["AC_POWER"] for r in rows] == [5, 0, 0, 7]
