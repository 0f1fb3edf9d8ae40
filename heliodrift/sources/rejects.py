"""Reading with a side table of what lenient parsing could not read: records and single cells."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliodrift.functions.parsing import lenient_number, nan_to_null, parse_time
from heliodrift.operators.columns import check_columns
from heliodrift.schemas import ORDER

RECORD = "_corrupt_record"
#: Columns of the side table besides the text of the row's keys.
REJECT_COLUMNS = ("column", "value", "reason")

NO_TIME = "unreadable time"
NO_NUMBER = "not a number"
NO_WHOLE_NUMBER = "not a whole number"
NO_KEY = "missing key"
WRONG_FIELDS = "wrong number of fields"


class Parsed(NamedTuple):
    frame: DataFrame
    rejects: DataFrame


def read_with_rejects(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    keys: Sequence[str] = ORDER,
) -> Parsed:
    """Typed readings, times and numbers read leniently, and a row for all that was not read.

    A record with more or fewer fields than the header is no reading: its line goes to
    ``rejects`` whole, with a null ``column``. A cell that is present but not readable is null in the
    reading and has a row of its own with its text; so has an absent key, as such readings are
    dropped later on. Rejects carry the keys as they stand in the file. The files' headers must agree.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    header = spark.read.option("header", True).csv(paths).columns
    shape = T.StructType([T.StructField(c, T.StringType()) for c in (*header, RECORD)])
    # Not enforcing the schema makes Spark compare every file's header with it.
    text = (
        spark.read.schema(shape)
        .options(header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD)
        # Whole lines are split, or a record with too many fields passes where few are asked for.
        .option("columnPruning", False)
        .csv(paths)
    )
    wanted = schema.fieldNames()
    check_columns(text, wanted)
    # Always true, but Spark refuses to read a file for the corrupt record alone, as a count would.
    some_field = F.coalesce(F.length(header[0]), F.lit(0)) >= 0
    whole = text.where(F.col(RECORD).isNull() & some_field)
    names = [c for c in header if c in wanted]
    frame = whole.select(*[_value(schema[c]).alias(c) for c in names])
    return Parsed(frame, _rejects(text, [schema[c] for c in names], [k for k in keys if k in names]))


def _value(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.TimestampNTZType):
        return parse_time(field.name)
    if isinstance(field.dataType, T.DoubleType):
        return nan_to_null(lenient_number(field.name))
    if isinstance(field.dataType, T.IntegerType):
        number = lenient_number(field.name)
        # A cast would cut the fraction off, and with it make another key.
        return F.when(number == F.floor(number), number.try_cast("int"))
    return F.col(field.name).cast(field.dataType)


def _reason(field: T.StructField, is_key: bool) -> Column:
    """Why a cell is lost, null if it is not."""
    text = F.col(field.name)
    lost = text.isNotNull() & _value(field).isNull()
    if isinstance(field.dataType, T.TimestampNTZType):
        reason = F.when(lost, NO_TIME)
    elif isinstance(field.dataType, T.IntegerType):
        reason = F.when(lost & lenient_number(field.name).isNull(), NO_NUMBER).when(lost, NO_WHOLE_NUMBER)
    else:
        # A NaN is a missing value that is spelt out, nothing that was lost.
        reason = F.when(lost & (F.lower(F.trim(text)) != "nan"), NO_NUMBER)
    return F.when(text.isNull(), NO_KEY).otherwise(reason) if is_key else reason


def _rejects(text: DataFrame, fields: Sequence[T.StructField], keys: Sequence[str]) -> DataFrame:
    """One row for each lost cell or record, in the pass that reads the text."""
    kind = "array<struct<column:string,value:string,reason:string>>"
    cells = [
        F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("value"), _reason(f, f.name in keys).alias("reason"))
        for f in fields
    ]
    record = F.struct(
        F.lit(None).cast("string").alias("column"), F.col(RECORD).alias("value"), F.lit(WRONG_FIELDS).alias("reason")
    )
    lost = F.when(F.col(RECORD).isNotNull(), F.array(record).cast(kind)).otherwise(
        F.filter(F.array(*cells).cast(kind), lambda cell: cell["reason"].isNotNull())
    )
    shown = [F.when(F.col(RECORD).isNull(), F.col(k)).alias(k) for k in keys]
    return text.select(*shown, F.explode(lost).alias("__lost")).select(*keys, "__lost.*")


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Append to the side table, a folder for each reason, which later runs add to."""
    rejects.write.mode("append").partitionBy("reason").parquet(path)


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Cells and records lost, by column and reason."""
    return rejects.groupBy("column", "reason").agg(F.count(F.lit(1)).alias("rows"))
