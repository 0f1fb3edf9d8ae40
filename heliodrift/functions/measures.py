"""Scalar expressions over the measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliodrift.schemas import STEP_MINUTES

INTERACTION = "TEMP_X_IRRADIATION"


def zero_if_null(value: Column | str) -> Column:
    return F.coalesce(value if isinstance(value, Column) else F.col(value), F.lit(0.0))


def clamp_at_zero(value: Column | str) -> Column:
    """Negative predictions become 0; NaN stays NaN."""
    return F.greatest(F.lit(0.0), value if isinstance(value, Column) else F.col(value))


def interaction() -> Column:
    return F.col("MODULE_TEMPERATURE") * F.col("IRRADIATION")


def energy(power: Column | str = "AC_POWER", minutes: int = STEP_MINUTES) -> Column:
    """Energy in kWh of one interval at constant power in kW."""
    return (power if isinstance(power, Column) else F.col(power)) * F.lit(minutes / 60.0)
