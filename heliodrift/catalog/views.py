"""Generation and weather readings in the shape of the workload, from ``events``.

The supplied event table stands in for inverter and weather logs: a user is an
inverter, ``error`` events are weather readings, everything else is generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliodrift.operators.combine import join_weather
from heliodrift.operators.sequences import running_total
from heliodrift.functions.measures import energy
from heliodrift.schemas import COMBINED_SCHEMA, ORDER, PLANT, SOURCE, STEP_MINUTES, TIME

# Fixed values of the fixture.
_FIRST_PLANT = 4135001
_PLANTS = 2
_SOURCES = 22
_LIFETIME_SEED = 1_000_000.0

# Layout of per-source windows over these views: generation() leaves one row per
# source and 15-minute bin, 35,064 a year, so a source always fits one task.
BY_SOURCE = "WHOLE"


# Given, so that no job reads a footer to infer it.
_EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(_EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def _bin() -> Column:
    # A tumbling window start stays naive; date_trunc would visit the session zone.
    return F.window("ts", f"{STEP_MINUTES} minutes")["start"].alias(TIME)


def _plant() -> Column:
    return (F.lit(_FIRST_PLANT) + (F.col("user_id") % _PLANTS).cast("int")).alias(PLANT)


def _source() -> Column:
    number = F.lpad((F.col("user_id") % _SOURCES).cast("string"), 2, "0")
    return F.concat(F.lit("INV"), number).alias(SOURCE)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def raw_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation readings before binning, with repeated keys and values."""
    return (
        events(spark, sf_dir)
        .where("event_type <> 'error'")
        .select(
            _bin(),
            _plant(),
            _source(),
            F.col("event_type"),
            F.col("value").alias("DC_POWER"),
            _k().alias("AC_POWER"),
        )
    )


def generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source and 15-minute bin, with both energy counters.

    The binning is a map-side combined aggregation, so a source that holds a third
    of the events is down to one row per bin before any window.
    """
    binned = (
        raw_generation(spark, sf_dir)
        .groupBy(*ORDER)
        .agg(F.max("DC_POWER").alias("DC_POWER"), F.max("AC_POWER").alias("AC_POWER"))
    )
    lifetime = running_total(
        binned, energy(), "TOTAL_YIELD", (SOURCE,), seed=_LIFETIME_SEED, cell=BY_SOURCE
    )
    daily = running_total(
        lifetime.withColumn("__day", F.to_date(TIME)),
        energy(),
        "DAILY_YIELD",
        (SOURCE, "__day"),
        cell=BY_SOURCE,
    )
    return daily.drop("__day")


def generation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation readings at their own, irregular times."""
    return (
        events(spark, sf_dir)
        .where("event_type <> 'error'")
        .select("event_id", F.col("ts").alias(TIME), _plant(), _source())
    )


def weather_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather readings at their own, irregular times, some of them at the same one."""
    return (
        events(spark, sf_dir)
        .where("event_type = 'error'")
        .select(
            F.col("event_id").alias("reading_id"),
            F.col("ts").alias(TIME),
            _plant(),
            (_k() / 4).alias("AMBIENT_TEMPERATURE"),
            F.col("value").alias("IRRADIATION"),
        )
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir)
        .where("event_type = 'error'")
        .select(_bin(), _plant(), F.col("value"), _k().alias("k"))
        .groupBy(TIME, PLANT)
        .agg(
            (F.max("k") / 4).alias("AMBIENT_TEMPERATURE"),
            (F.max("k") / 2).alias("MODULE_TEMPERATURE"),
            F.max("value").alias("IRRADIATION"),
        )
    )


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_weather(generation(spark, sf_dir), weather(spark, sf_dir)).select(
        *COMBINED_SCHEMA.fieldNames()
    )
