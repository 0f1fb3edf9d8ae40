"""Column-level helpers: presence checks, selections, missing features."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumns(ValueError):
    """Required columns are absent."""


def check_columns(
    df: DataFrame, required: Iterable[str], strict: bool = True
) -> list[str]:
    """The required columns that exist; absent ones raise, or warn if not strict."""
    required = list(required)
    absent = [c for c in required if c not in df.columns]
    if absent and strict:
        raise MissingColumns(f"missing columns: {', '.join(absent)}")
    if absent:
        warnings.warn(f"columns not found: {', '.join(absent)}", stacklevel=2)
    return [c for c in required if c in df.columns]


def existing(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The names that are columns of ``df``, in a fixed (sorted) order."""
    return sorted(set(names) & set(df.columns))


def with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def with_suffix(df: DataFrame, *suffixes: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffixes)]


def containing(df: DataFrame, *parts: str) -> list[str]:
    return [c for c in df.columns if any(part in c for part in parts)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def add_missing(df: DataFrame, names: Iterable[str], value: float = 0.0) -> DataFrame:
    """Add each absent name as a constant column."""
    absent = [c for c in dict.fromkeys(names) if c not in df.columns]
    return df.withColumns({c: F.lit(value) for c in absent}) if absent else df


def has_at_least(df: DataFrame, rows: int) -> bool:
    """Whether there are ``rows`` rows, reading no more than needed."""
    return df.limit(rows).count() >= rows


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no rows left after cleaning")
    return df


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(keys))


def strip_forecast_suffix(name: str) -> str:
    """The history column a forecast column continues."""
    return name.replace("_forecasted", "")
