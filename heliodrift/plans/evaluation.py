"""Rolling-origin evaluation: the end of the history is forecast again and again, from ever earlier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliodrift.functions.calendar import seconds_between
from heliodrift.operators.asof import nearest_rows
from heliodrift.schemas import ENTITY, POWER, TIME, WEATHER

#: Fixed value: hours of a fold's test period.
TEST_HOURS = 48
_HOUR, _DAY = 3_600, 24 * 3_600
FOLD = "fold"


def fold_number(latest: Column, hours: int = TEST_HOURS, time: str = TIME) -> Column:
    """0 for the last ``hours`` of the table, 1 for those before them, and so on.

    The latest reading is the last one of fold 0; a fold's cutoff is the time its first reading
    must be later than.
    """
    age = seconds_between(latest, F.col(time))
    return F.floor(age / (hours * _HOUR)).cast("int")


def rolling_persistence(
    history: DataFrame,
    columns: Sequence[str] = WEATHER + POWER,
    by: Sequence[str] = ENTITY,
    folds: int | None = None,
    hours: int = TEST_HOURS,
    cell: str | None = None,
) -> DataFrame:
    """Each reading of a fold beside its forecast, the reading a day earlier that the fold may know.

    Readings up to the cutoff are known, so on a fold's second day the forecast goes two days
    back. The nearest reading is looked for among the ``hours`` before the cutoff, which are the
    test period of the fold before: a reading is truth once and evidence once at most, and all
    folds are one join. No ``folds`` takes all; the oldest fold has no evidence and no forecast.
    """
    latest = history.select(F.max(TIME)).scalar()
    placed = history.where(F.col(TIME).isNotNull()).withColumn(FOLD, fold_number(latest, hours))
    tests = placed if folds is None else placed.where(F.col(FOLD) < folds)
    cutoff_age = (F.col(FOLD) + 1) * hours * _HOUR
    after_cutoff = cutoff_age - seconds_between(latest, F.col(TIME))
    # (0 h, 24 h] after the cutoff goes one day back, (24 h, 48 h] two.
    days = F.ceil(after_cutoff / _DAY)
    wanted = tests.select(
        *by, FOLD, F.col(TIME).alias("truth_time"), *[F.col(c).alias(f"{c}_truth") for c in columns],
        (F.col(TIME) - F.make_dt_interval(days=days.cast("int"))).alias(TIME),
    )
    known = placed.where(F.col(FOLD) > 0).withColumn(FOLD, F.col(FOLD) - 1)
    if folds is not None:
        known = known.where(F.col(FOLD) < folds)
    found = nearest_rows(wanted, known, columns, (*by, FOLD), cell=cell)
    return found.drop(TIME, f"{TIME}_found").withColumnRenamed("truth_time", TIME)


def fold_scores(forecasts: DataFrame, columns: Sequence[str] = WEATHER + POWER) -> DataFrame:
    """Mean absolute and squared error and R2 by column, for each fold and (null) over all of them.

    One aggregation; rows without a forecast are counted, not scored. R2 is null where the truth
    does not vary.
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(f"{c}_truth").alias("truth"), F.col(c).alias("guess"))
                for c in columns
            ]
        )
    )
    long = forecasts.select(FOLD, pairs.alias("pair")).select(FOLD, "pair.*")
    off = F.when(F.col("guess").isNotNull(), F.col("guess") - F.col("truth"))
    truth = F.when(off.isNotNull(), F.col("truth"))
    square, spread = F.sum(off * off), F.var_pop(truth) * F.count(truth)
    scores = long.rollup("column", FOLD).agg(
        F.count(off).alias("rows"),
        F.count_if(off.isNull()).alias("unscored"),
        F.avg(F.abs(off)).alias("mae"),
        F.avg(off * off).alias("mse"),
        F.when(spread > 0, 1 - square / spread).alias("r2"),
    )
    return scores.where(F.col("column").isNotNull())
