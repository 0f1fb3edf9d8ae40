"""Column names, row order and table schemas shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

TIME = "DATE_TIME"
PLANT = "PLANT_ID"
SOURCE = "SOURCE_KEY"

# One series per inverter.
ENTITY = (PLANT, SOURCE)
# The documented total order; ties inside it are broken by row content
# (see operators.layout).
ORDER = (TIME, PLANT, SOURCE)

WEATHER = ("AMBIENT_TEMPERATURE", "MODULE_TEMPERATURE", "IRRADIATION")
POWER = ("DC_POWER", "AC_POWER")
YIELDS = ("DAILY_YIELD", "TOTAL_YIELD")
MEASURES = WEATHER + POWER + YIELDS

DAILY_FORECAST = "DAILY_YIELD_forecasted"
TOTAL_FORECAST = "TOTAL_YIELD_forecasted"

# Fixed workload values: a 24 hour horizon of 15-minute steps.
STEP_MINUTES = 15
HORIZON = 96
STEPS_PER_HOUR = 4
# An hour and a day back, and three hours.
LAGS = (STEPS_PER_HOUR, HORIZON)
MEAN_ROWS = 3 * STEPS_PER_HOUR

_KEYS = [
    T.StructField(TIME, T.TimestampNTZType()),
    T.StructField(PLANT, T.IntegerType()),
]


def _doubles(names):
    return [T.StructField(name, T.DoubleType()) for name in names]


GENERATION_SCHEMA = T.StructType(
    _KEYS + [T.StructField(SOURCE, T.StringType())] + _doubles(POWER + YIELDS)
)
WEATHER_SCHEMA = T.StructType(_KEYS + _doubles(WEATHER))
COMBINED_SCHEMA = T.StructType(GENERATION_SCHEMA.fields + _doubles(WEATHER))
FUTURE_WEATHER_SCHEMA = T.StructType(_KEYS[:1] + _doubles(WEATHER))

# The nine-column preview projection; IRRADIATION is left out on purpose.
PREVIEW_COLUMNS = (
    TIME,
    PLANT,
    SOURCE,
    "DC_POWER",
    "AC_POWER",
    "DAILY_YIELD",
    "TOTAL_YIELD",
    "AMBIENT_TEMPERATURE",
    "MODULE_TEMPERATURE",
)
