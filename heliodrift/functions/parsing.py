"""Text to typed columns: times (two known shapes) and lenient numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two text shapes the workload holds. ISO text is never read
# day first, so 2020-05-06 is the sixth of May whatever its neighbours look like.
ISO_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?$"
DAY_FIRST_SHAPE = r"^[0-9]{2}-[0-9]{2}-[0-9]{4} [0-9]{2}:[0-9]{2}(:[0-9]{2})?$"
NUMBER_SHAPE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_SHAPE = r"^[+-]?(inf|infinity)$"


def parse_time_format(text: Column | str, pattern: str) -> Column:
    """Parse with one explicit format; text that does not fit raises."""
    return F.to_timestamp_ntz(text, F.lit(pattern))


def parse_time(text: Column | str) -> Column:
    """Parse either known shape; anything else becomes null.

    ``try_cast`` straight to ``timestamp_ntz`` keeps the session time zone out.
    """
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    iso = F.when(
        text.rlike(DAY_FIRST_SHAPE),
        F.regexp_replace(text, r"^([0-9]{2})-([0-9]{2})-([0-9]{4}) ", "$3-$2-$1 "),
    ).when(text.rlike(ISO_SHAPE), text)
    return iso.try_cast("timestamp_ntz")


def parse_time_strict(text: Column | str) -> Column:
    """As :func:`parse_time`, but text that is present and fits no shape raises."""
    text = F.col(text) if isinstance(text, str) else text
    parsed = parse_time(text)
    complaint = F.raise_error(F.concat(F.lit("unreadable time: "), text)).cast(
        "timestamp_ntz"
    )
    return F.when(text.isNotNull() & parsed.isNull(), complaint).otherwise(parsed)


def lenient_number(text: Column | str) -> Column:
    """Text to double; unreadable text and NaN become null.

    The shape test keeps out Java-only spellings such as ``1d``, which a cast takes.
    """
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    fits = text.rlike(NUMBER_SHAPE) | F.lower(text).rlike(INFINITY_SHAPE)
    return F.when(fits, text.try_cast("double"))


def nan_to_null(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value), value)
