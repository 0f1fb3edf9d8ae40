"""The history as a table with one folder a day: days are reloaded and read by themselves."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliodrift.schemas import TIME

DAY = "DATE"
#: Rows of a file, so that a day of any size is read in pieces.
FILE_ROWS = 5_000_000


def write_days(df: DataFrame, path: str, time: str = TIME, file_rows: int = FILE_ROWS) -> None:
    """Write the days of ``df``; days that it holds no row of stay as they are.

    A day that was there is replaced whole. Rows are dealt by day in partitions of about equal
    size, so a day that holds most rows is written by many tasks, and many small days by few.
    Rows without a time have a folder of their own.
    """
    dated = df.withColumn(DAY, F.to_date(time)).hint("rebalance", DAY)
    (
        dated.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", file_rows)
        .partitionBy(DAY)
        .parquet(path)
    )


def read_days(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    first: datetime.date | None = None,
    last: datetime.date | None = None,
) -> DataFrame:
    """Rows of the days from ``first`` to ``last``, both included; other days' files are not opened."""
    table = spark.read.schema(_dated(schema)).parquet(path)
    if first is not None:
        table = table.where(F.col(DAY) >= F.lit(first))
    if last is not None:
        table = table.where(F.col(DAY) <= F.lit(last))
    return table.select(*schema.fieldNames())


def stored_days(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The days of the table and their rows, counted from the files' footers, without their columns."""
    return spark.read.schema(_dated(schema)).parquet(path).groupBy(DAY).agg(F.count(F.lit(1)).alias("rows"))


def read_last_days(spark: SparkSession, path: str, schema: T.StructType, days: int) -> DataFrame:
    """Rows of the latest day of the table and the ``days - 1`` calendar days before it."""
    latest = stored_days(spark, path, schema).agg(F.max(DAY).alias("day")).first()["day"]
    if latest is None:
        return read_days(spark, path, schema).limit(0)
    return read_days(spark, path, schema, latest - datetime.timedelta(days=days - 1), latest)


def _dated(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])
