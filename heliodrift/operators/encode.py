"""One-hot columns and standard scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodrift.operators.columns import numeric_columns, with_prefix, with_suffix
from heliodrift.operators.profile import over_two_values
from heliodrift.schemas import PLANT, SOURCE

PREFIXES = {PLANT: "PLANT", SOURCE: "SOURCE"}


class TooManyValues(ValueError):
    """A column has more distinct values than the caller allows dummy columns."""


def category_values(
    df: DataFrame, column: str, max_values: int | None = None
) -> list[str]:
    """The sorted distinct values as text, nulls left out; raises past a bound if one is given.

    Each value becomes a column of the plan; for many values see :func:`sparse_one_hot`.
    """
    text = F.col(column).cast("string").alias("value")
    found = df.select(text).where("value is not null").distinct()
    if max_values is not None:
        found = found.limit(max_values + 1)
    values = sorted(row["value"] for row in found.collect())
    if max_values is not None and len(values) > max_values:
        raise TooManyValues(f"{column} has more than {max_values} values")
    return values


def category_map(
    df: DataFrame,
    columns: Sequence[str] = tuple(PREFIXES),
    max_values: int | None = None,
) -> dict[str, list[str]]:
    return {c: category_values(df, c, max_values) for c in columns}


def dummy_names(categories: dict[str, list[str]]) -> list[str]:
    return [f"{PREFIXES.get(c, c)}_{v}" for c, vs in categories.items() for v in vs]


def one_hot(
    df: DataFrame, categories: dict[str, list[str]], keep: bool = True
) -> DataFrame:
    """A 0/1 column per value, none dropped; a null gives 0 in all of them."""
    added = {
        f"{PREFIXES.get(c, c)}_{v}": F.coalesce(
            (F.col(c).cast("string") == v).cast("double"), F.lit(0.0)
        )
        for c, values in categories.items()
        for v in values
    }
    encoded = df.withColumns(added)
    return encoded if keep else encoded.drop(*categories)


def sparse_one_hot(columns: Sequence[str] = tuple(PREFIXES)) -> Pipeline:
    """The same encoding as one sparse vector per column, for many values.

    Null takes the extra index that ``keep`` adds, and that is the one dropped, so
    null is all zeros and every real value keeps its slot.
    """
    indexed = [f"{c}_index" for c in columns]
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=list(columns),
                outputCols=indexed,
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            ),
            OneHotEncoder(
                inputCols=indexed,
                outputCols=[vector_name(c) for c in columns],
                dropLast=True,
            ),
        ]
    )


def vector_name(column: str) -> str:
    return f"{PREFIXES.get(column, column)}_vector"


@dataclass(frozen=True)
class EntityEncoder:
    """Plant and source as a sparse vector each, whose slots are the sorted values."""

    names: tuple[str, ...]
    vectors: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        encoded = self.vectors.transform(df)
        return encoded.drop(*[f"{c}_index" for c in PREFIXES])


def fit_entity_encoder(df: DataFrame) -> EntityEncoder:
    """The slots of the dummies, in their order, however many there are."""
    vectors = sparse_one_hot().fit(df.select(*PREFIXES))
    return EntityEncoder(tuple(map(vector_name, PREFIXES)), vectors)


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations, reused as literals at forecast time."""

    means: dict[str, float]
    deviations: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        # A constant column has deviation 0 and is only centred.
        return df.withColumns(
            {
                c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.deviations[c] or 1.0)
                for c in self.means
                if c in df.columns
            }
        )


def scalable_columns(
    df: DataFrame,
    columns: Sequence[str],
    skip_cyclical: bool = False,
    count_null: bool = False,
) -> list[str]:
    """Numeric columns with more than two values that are not dummies."""
    numeric = set(numeric_columns(df))
    left_out = set(with_prefix(df, *[f"{p}_" for p in PREFIXES.values()]))
    if skip_cyclical:
        left_out.update(with_suffix(df, "_sin", "_cos"))
    chosen = [c for c in columns if c in numeric and c not in left_out]
    varied = over_two_values(df, chosen)
    return [c for c in chosen if varied[c][count_null]]


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """One pass over the columns; the driver gets one row."""
    if not columns:
        return Scaler({}, {})
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return Scaler(
        {c: row[f"m_{c}"] for c in columns}, {c: row[f"s_{c}"] for c in columns}
    )
