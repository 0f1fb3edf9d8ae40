"""Run a function over Arrow batches of bounded size, and read bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task handles at a time; a longer text is handled alone.
STEP_BYTES = 500_000


def text_slices(batch: pa.RecordBatch, column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each slice hold ``step`` bytes, or one row does."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for row, size in enumerate(sizes):
        if row > start and total + size > step:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def free_memory() -> None:
    """Give Arrow's unused memory back: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()


def map_text(
    df: DataFrame, column: str, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``function`` over slices of ``df`` that hold a bounded amount of ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column):
                yield function(part)
        free_memory()

    return df.mapInArrow(run, schema)


def sample_ids(df: DataFrame, column: str, rows: int) -> DataFrame:
    """``rows`` ids at most, those with the smallest hash: the same at any partitioning."""
    ids = df.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    return ids.orderBy(F.xxhash64(column), column).limit(rows)


def held_out(column: str) -> Column:
    """Whether crc32 of the id as text leaves no remainder by five; a null id is not."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``, null ids compared as equal; columns stay."""
    wanted = ids.select(F.col(ids.columns[0]).alias("__id"))
    return docs.join(wanted, docs[column].eqNullSafe(F.col("__id")), "left_semi")
