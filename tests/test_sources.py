"""CSV and Parquet round trips, and weather for the forecast period."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException

from heliodrift.operators.columns import MissingColumns
from heliodrift.operators.spine import future_spine
from heliodrift.schemas import (
    COMBINED_SCHEMA,
    GENERATION_SCHEMA,
    HORIZON,
    PREVIEW_COLUMNS,
    WEATHER_SCHEMA,
)
from heliodrift.sources.csv_files import (
    preview_columns,
    read_combined,
    read_generation,
    read_inferred,
    read_readings,
    read_weather,
    write_csv,
    write_parquet,
)
from heliodrift.sources.future_weather import load_future_weather

GENERATION = [
    (datetime(2020, 5, 15), 1, "A", 1.5, None, 0.25, 1e7),
    (datetime(2020, 5, 15, 0, 15), 1, "B", None, 2.0, 0.0, 123456.789),
]


def write_text(path, text):
    path.write_text(text)
    return str(path)


@pytest.fixture
def generation(spark):
    return spark.createDataFrame(GENERATION, GENERATION_SCHEMA)


def test_csv_round_trip_keeps_nulls_and_times(spark, tmp_path, generation):
    path = str(tmp_path / "generation")
    write_csv(generation, path)
    write_csv(generation, path)  # overwrites
    back = read_generation(spark, path, times="strict")
    assert back.schema == GENERATION_SCHEMA
    assert sorted(map(tuple, back.collect())) == GENERATION
    assert read_inferred(spark, path).columns == GENERATION_SCHEMA.fieldNames()


def test_parquet_round_trip(spark, tmp_path, generation):
    write_parquet(generation, str(tmp_path / "g"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "g")).collect())) == GENERATION


def test_columns_are_found_by_name(spark, tmp_path):
    path = write_text(
        tmp_path / "w.csv",
        "IRRADIATION,extra,PLANT_ID,DATE_TIME,AMBIENT_TEMPERATURE,MODULE_TEMPERATURE\n"
        "0.5,z,4135001.0,15-05-2020 00:00,NaN,x\n",
    )
    df = read_weather(spark, path)
    # File column order is kept, the extra column is not read.
    assert df.columns == ["IRRADIATION", "PLANT_ID", "DATE_TIME", "AMBIENT_TEMPERATURE", "MODULE_TEMPERATURE"]
    assert tuple(df.first()) == (0.5, 4135001, datetime(2020, 5, 15), None, None)
    plan = df.select("IRRADIATION")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<IRRADIATION:string>" in plan


def test_missing_column_and_path(spark, tmp_path):
    path = write_text(tmp_path / "w.csv", "DATE_TIME,PLANT_ID\n2020-05-15 00:00:00,1\n")
    with pytest.raises(MissingColumns, match="IRRADIATION"):
        read_weather(spark, path)
    assert read_readings(spark, path, WEATHER_SCHEMA, columns=["DATE_TIME"]).count() == 1
    with pytest.raises(AnalysisException, match="no-such-file"):
        read_combined(spark, str(tmp_path / "no-such-file.csv"))


def test_many_files_with_different_columns(spark, tmp_path):
    one = write_text(tmp_path / "1.csv", "DATE_TIME,PLANT_ID,IRRADIATION,AMBIENT_TEMPERATURE,MODULE_TEMPERATURE\n2020-05-15 00:00:00,1,1,2,3\n")
    two = write_text(tmp_path / "2.csv", "PLANT_ID,DATE_TIME,IRRADIATION\n2,15-05-2020 00:00,4\n")
    rows = {r["PLANT_ID"]: r for r in read_weather(spark, [one, two]).collect()}
    assert rows[2]["IRRADIATION"] == 4.0 and rows[2]["MODULE_TEMPERATURE"] is None
    assert rows[1]["MODULE_TEMPERATURE"] == 3.0
    assert rows[1]["DATE_TIME"] == rows[2]["DATE_TIME"]


def test_preview_leaves_irradiation_out(spark):
    df = spark.createDataFrame([], COMBINED_SCHEMA)
    assert tuple(preview_columns(df).columns) == PREVIEW_COLUMNS
    with pytest.raises(MissingColumns):
        preview_columns(df.drop("AC_POWER"))


@pytest.fixture
def spine(spark):
    history = spark.createDataFrame([(datetime(2020, 5, 15, 23, 45),)], "DATE_TIME timestamp_ntz")
    return future_spine(history)


def weather_file(path, rows, header="DATE_TIME,AMBIENT_TEMPERATURE,MODULE_TEMPERATURE,IRRADIATION"):
    return write_text(path, "\n".join([header, *rows]) + "\n")


def test_future_weather_from_file(spark, spine, tmp_path):
    start = datetime(2020, 5, 16)
    rows = [f"{start + timedelta(minutes=15 * i)},{i},{'x' if i == 3 else 2 * i},1" for i in range(2, 90)]
    rows.append("2031-01-01 00:00:00,5,5,5")
    found = load_future_weather(spark, spine, weather_file(tmp_path / "f.csv", rows))
    assert found.reason == "read from file"
    got = found.frame.orderBy("DATE_TIME").collect()
    assert len(got) == HORIZON
    ambient = [r["AMBIENT_TEMPERATURE"] for r in got]
    assert ambient[:3] == [2.0, 2.0, 2.0] and ambient[-7:] == [89.0] * 7
    assert [r["MODULE_TEMPERATURE"] for r in got][2:5] == [4.0, 4.0, 8.0]


@pytest.mark.parametrize(
    "rows,header,reason",
    [
        (["2020-05-16 00:00:00,1,2,"], None, "no values for IRRADIATION"),
        (["2020-05-16 00:00:00,1,2,3"] * 2, None, "repeated"),
        (["2020-05-16 00:00:00,1"], "DATE_TIME,AMBIENT_TEMPERATURE", "missing columns"),
        (["junk,1,2,3"], None, "unreadable time"),
        (["2019-01-01 00:00:00,1,2,3"], None, "no values"),
    ],
)
def test_unusable_future_weather(spark, spine, tmp_path, rows, header, reason):
    path = weather_file(tmp_path / "f.csv", rows, *([header] if header else []))
    found = load_future_weather(spark, spine, path)
    assert found.frame is None and reason in found.reason


def test_no_future_weather(spark, spine, tmp_path):
    assert load_future_weather(spark, spine).frame is None
    absent = load_future_weather(spark, spine, str(tmp_path / "absent.csv"))
    assert absent.frame is None and "absent.csv" in absent.reason


def test_weather_of_files_with_different_headers_is_a_reason(spark, tmp_path):
    """The error comes from the job that reads the folder, not from its plan."""
    header = "DATE_TIME,AMBIENT_TEMPERATURE,MODULE_TEMPERATURE,IRRADIATION"
    (tmp_path / "a.csv").write_text(f"{header}\n2020-05-16 00:00:00,1,2,3\n")
    (tmp_path / "b.csv").write_text("IRRADIATION,DATE_TIME,MODULE_TEMPERATURE,AMBIENT_TEMPERATURE\n1,2020-05-16 00:15:00,2,3\n")
    history = spark.createDataFrame([(datetime(2020, 5, 15, 23, 45),)], "DATE_TIME timestamp_ntz")
    found = load_future_weather(spark, future_spine(history), str(tmp_path))
    assert found.frame is None and found.reason
