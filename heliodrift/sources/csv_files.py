"""CSV and Parquet sources and sinks of readings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliodrift.functions.parsing import (
    lenient_number,
    nan_to_null,
    parse_time,
    parse_time_format,
    parse_time_strict,
)
from heliodrift.operators.columns import check_columns
from heliodrift.operators.combine import union_plants
from heliodrift.schemas import (
    COMBINED_SCHEMA,
    GENERATION_SCHEMA,
    PREVIEW_COLUMNS,
    WEATHER_SCHEMA,
)


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Header and inferred types. Inferring reads the file once more; an absent
    path raises an ``AnalysisException`` that names it."""
    return spark.read.csv(path, header=True, inferSchema=True)



def read_text(
    spark: SparkSession, paths: str | Sequence[str], mixed: bool = False
) -> DataFrame:
    """Every column as text, united by name.

    One folder is read by the header of one of its files, and the job raises if another
    file's header differs from it. Several paths, or ``mixed=True``, are read by header: a
    pass over the text groups the files by their first lines, and each header is one scan
    however many files have it.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if len(paths) == 1 and not mixed:
        return _by_header(spark, paths)
    return reduce(union_plants, [_by_header(spark, files) for files in _same_headers(spark, paths)])


def _by_header(spark: SparkSession, paths: list[str]) -> DataFrame:
    # Not enforcing the schema makes Spark compare every file's header with it.
    return spark.read.option("header", True).option("enforceSchema", False).csv(paths)


def _same_headers(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """Files grouped by their first line; the driver gets one row for each file."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
        F.monotonically_increasing_id().alias("line"),
    )
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    files = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return [row["files"] for row in files.orderBy("files").collect()]


def read_readings(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    times: str = "lenient",
    columns: Sequence[str] | None = None,
    raw: bool = False,
    mixed: bool = False,
) -> DataFrame:
    """Read CSV readings with the columns and types of ``schema``.

    Columns are found by header name, so their order in the file does not matter,
    and only the wanted ones are parsed; a wanted column that is absent raises.
    ``times`` is ``lenient`` (unreadable becomes null), ``strict`` (it raises) or an
    explicit pattern such as ``dd-MM-yyyy HH:mm`` (it raises too). ``raw`` leaves measures
    as text, for :func:`heliodrift.plans.clean.clean` to tell missing from unreadable.
    ``mixed`` allows a folder of files with different headers.
    """
    text = read_text(spark, paths, mixed)
    wanted = list(columns or schema.fieldNames())
    check_columns(text, wanted)
    # File column order is kept.
    names = [c for c in text.columns if c in wanted]
    kept = {c for c in names if raw and isinstance(schema[c].dataType, T.DoubleType)}
    return text.select([F.col(c) if c in kept else _typed(schema[c], times).alias(c) for c in names])


def _typed(field: T.StructField, times: str) -> Column:
    if isinstance(field.dataType, T.TimestampNTZType):
        if times == "lenient":
            return parse_time(field.name)
        if times == "strict":
            return parse_time_strict(field.name)
        return parse_time_format(field.name, times)
    if isinstance(field.dataType, T.DoubleType):
        return nan_to_null(lenient_number(field.name))
    if isinstance(field.dataType, T.IntegerType):
        # A whole number that once shared a column with nulls may read 4135001.0.
        return lenient_number(field.name).try_cast("int")
    return F.col(field.name).cast(field.dataType)


def read_generation(spark, paths, times: str = "lenient", raw: bool = False) -> DataFrame:
    return read_readings(spark, paths, GENERATION_SCHEMA, times, raw=raw)


def read_weather(spark, paths, times: str = "lenient", raw: bool = False) -> DataFrame:
    return read_readings(spark, paths, WEATHER_SCHEMA, times, raw=raw)


def read_combined(spark, paths, times: str = "lenient", raw: bool = False) -> DataFrame:
    return read_readings(spark, paths, COMBINED_SCHEMA, times, raw=raw)


def preview_columns(df: DataFrame) -> DataFrame:
    """The nine columns of the preview, IRRADIATION not among them."""
    check_columns(df, PREVIEW_COLUMNS)
    return df.select(*PREVIEW_COLUMNS)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite a folder of CSV files: header, empty text for null."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
