"""Chained random forests: training, scoring and the day-ahead forecast."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodrift.functions.calendar import CALENDAR_COLUMNS, CYCLICAL_COLUMNS
from heliodrift.functions.measures import INTERACTION, clamp_at_zero
from heliodrift.operators.columns import (
    add_missing,
    existing,
    has_at_least,
    numeric_columns,
)
from heliodrift.operators.encode import (
    EntityEncoder,
    Scaler,
    fit_entity_encoder,
    fit_scaler,
    scalable_columns,
)
from heliodrift.operators.sequences import lag_mean_names
from heliodrift.operators.spine import entity_spine
from heliodrift.plans.ensembles import (
    ROWS_IN_TASK,
    Ensemble,
    fit_drawn,
    fit_groups,
    fit_quality,
    out_of_bag,
    side_by_side,
)
from heliodrift.plans.features import future_features, history_features, time_features
from heliodrift.plans.persistence import (
    FORECAST_COLUMNS,
    continue_yields,
    persistence_weather,
)
from heliodrift.schemas import ENTITY, ORDER, POWER, TIME, WEATHER
from heliodrift.session import shared_folder

# Predictions of these are clamped at 0; temperatures are not.
NON_NEGATIVE = ("IRRADIATION", *POWER)
_VECTOR = "__features"
# Tasks of a training pass: on large tables so many that each has a bounded number of rows. On
# small ones both grow, since each task sends split statistics of all nodes, whatever its rows.
_SMALL_TASK_ROWS, _SMALL_TASKS, _SMALL_GROWTH = 1_000, 64, 0.6
_TASK_ROWS = 200_000
# The least tasks of a pass over all trees of a frame that is too large for one.
_WIDE_TASKS = 16
# Fits that run at the same time; each waits for the result of every level.
FIT_THREADS = 6
# The same for single trees, whose passes are short.
TREE_THREADS = 12


@dataclass(frozen=True)
class ForestProfile:
    """Forest size and training rules.

    Every feature is tried at every split and each tree gets a full-size bootstrap.
    Splits are binned, so results are close to, not equal to, exact-split forests.
    """

    trees: int
    depth: int
    min_leaf: int
    min_rows: int
    skip_cyclical: bool
    count_null: bool = False
    bins: int = 128
    seed: int = 42
    bootstrap: bool = True
    # Split statistics a task may hold; more means fewer passes over the data.
    memory_mb: int = 256
    # Trees fitted together; None fits all at once.
    group_trees: int | None = None
    # Bootstrap samples follow from the rows' keys, see ``fit_groups``.
    by_keys: bool = False


# Split needs 10 rows: the nearest setting is a leaf of 5.
CHAIN_PROFILE = ForestProfile(50, 15, 5, 10, skip_cyclical=False)
# Split needs 8 rows: implied by the leaf of 4.
LAG_PROFILE = ForestProfile(150, 25, 4, 20, skip_cyclical=True, count_null=True, group_trees=25, by_keys=True)

# Which earlier targets each target learns from.
CHAIN_INPUTS = {
    "AMBIENT_TEMPERATURE": (),
    "IRRADIATION": (),
    "MODULE_TEMPERATURE": ("AMBIENT_TEMPERATURE", "IRRADIATION"),
    "DC_POWER": WEATHER,
    "AC_POWER": ("DC_POWER", *WEATHER),
}
# Every input is forecast before it is needed.
DEPENDENCY_ORDER = tuple(CHAIN_INPUTS)
# The listed order puts MODULE_TEMPERATURE before the irradiation it needs, which
# then enters as 0.
LISTED_ORDER = (*WEATHER, *POWER)


@dataclass(frozen=True)
class TargetModel:
    """A fitted forest with its ordered features and scaling."""

    target: str
    features: tuple[str, ...]
    scaler: Scaler
    forest: Ensemble

    def predict(self, df: DataFrame) -> DataFrame:
        """Add (or replace) the target; features that are absent count as 0."""
        kept = [c for c in df.columns if c != self.target]
        ready = _assembled(add_missing(df, self.features), self.features, self.scaler)
        value = F.col("__prediction")
        if self.target in NON_NEGATIVE:
            value = clamp_at_zero(value)
        return self.forest.transform(ready).select(*kept, value.alias(self.target))


def _assembled(df: DataFrame, features: Sequence[str], scaler: Scaler) -> DataFrame:
    """Scaled copies of the features in one vector; the columns stay as they are."""
    numbers = set(numeric_columns(df))
    scaled = {
        f"__x_{c}": (F.col(c) - F.lit(scaler.means[c]))
        / F.lit(scaler.deviations[c] or 1.0)
        if c in scaler.means
        else F.col(c).cast("double") if c in numbers else F.col(c)
        for c in features
    }
    return VectorAssembler(inputCols=list(scaled), outputCol=_VECTOR).transform(
        df.withColumns(scaled)
    )


def training_frame(df: DataFrame) -> DataFrame:
    """Fix the rows, their partitions and their order, then write them once.

    Bootstrap samples depend on where each row sits, so this makes equal seeds give
    equal forests; and several fits read the frame without computing it again.
    """
    shared_folder(df.sparkSession)
    # From the rows alone: a session setting must not change the bootstrap samples.
    parts = training_parts(df.count())
    # By content, so that a key held by a large share of the rows still spreads.
    placed = df.repartition(parts, *df.columns).sortWithinPartitions(
        *ORDER, F.xxhash64(*df.columns)
    )
    return placed.checkpoint()


def training_parts(rows: int) -> int:
    small = math.ceil((rows / _SMALL_TASK_ROWS) ** _SMALL_GROWTH)
    return max(1, min(_SMALL_TASKS, small), -(-rows // _TASK_ROWS))


def train_target(
    frame: DataFrame,
    target: str,
    features: Sequence[str],
    profile: ForestProfile,
    scaler: Scaler | None = None,
    folder: str | None = None,
    threads: int = 1,
) -> TargetModel | None:
    """Fit one forest, or return None when columns or rows are lacking.

    ``folder`` keeps groups of trees as they are ready, see :func:`fit_groups`.
    """
    features = existing(frame, features)
    if target not in frame.columns or not features:
        return None
    if not has_at_least(frame, profile.min_rows):
        return None
    if scaler is None:
        scaler = scaler_for(frame, features, profile)
    scaler = _only(scaler, features)
    keys = [c for c in existing(frame, ORDER) if c != target] if profile.by_keys else []
    data = _assembled(frame, features, scaler).select(*keys, _VECTOR, F.col(target))
    forest = fit_groups(data, _VECTOR, target, profile, folder, threads, keys)
    return TargetModel(target, tuple(features), scaler, forest)


def _only(scaler: Scaler, features: Sequence[str]) -> Scaler:
    return Scaler(
        {c: m for c, m in scaler.means.items() if c in features},
        {c: s for c, s in scaler.deviations.items() if c in features},
    )


def scaler_for(
    frame: DataFrame, features: Sequence[str], profile: ForestProfile
) -> Scaler:
    columns = scalable_columns(
        frame, existing(frame, features), profile.skip_cyclical, profile.count_null
    )
    return fit_scaler(frame, columns)


def chain_features(dummies: Sequence[str]) -> dict[str, list[str]]:
    """Each target's features in the weather-and-power chain."""
    base = [*CALENDAR_COLUMNS, *dummies]
    return {target: [*base, *inputs] for target, inputs in CHAIN_INPUTS.items()}


def lag_features(dummies: Sequence[str]) -> dict[str, list[str]]:
    """Each power's features when the weather is given."""
    base = [*CALENDAR_COLUMNS, *CYCLICAL_COLUMNS, *dummies, *WEATHER, INTERACTION]
    dc = [*base, *lag_mean_names((*WEATHER, "DC_POWER"))]
    return {
        "DC_POWER": dc,
        "AC_POWER": [*dc, "DC_POWER", *lag_mean_names(("AC_POWER",))],
    }


def train_chain(
    frame: DataFrame,
    features: dict[str, list[str]],
    profile: ForestProfile,
    folder: str | None = None,
    threads: int = FIT_THREADS,
) -> dict[str, TargetModel]:
    """A forest per target, on the actual values of earlier targets.

    So no target waits for another one: they are fitted side by side.
    """
    every = sorted({c for names in features.values() for c in names})
    scaler = scaler_for(frame, every, profile)
    models = side_by_side(
        frame.sparkSession,
        lambda target: train_target(
            frame, target, features[target], profile, scaler, folder, max(1, threads // len(features))
        ),
        list(features),
        threads,
    )
    return {target: model for target, model in zip(features, models, strict=True) if model}


def predict_chain(
    future: DataFrame,
    models: dict[str, TargetModel],
    targets: Sequence[str] = DEPENDENCY_ORDER,
) -> DataFrame:
    """Predict in order, each prediction feeding the next; no model gives 0."""
    for target in targets:
        if target in models:
            future = models[target].predict(future)
        else:
            future = future.withColumn(target, F.lit(0.0))
    return future


@dataclass(frozen=True)
class ModelSet:
    """What a forecast needs besides the history: fitted forests and the encoding of the keys."""

    kind: str  # "chain" or "lag"
    models: dict[str, TargetModel]
    encoder: EntityEncoder


def fit_chain(
    history: DataFrame, profile: ForestProfile = CHAIN_PROFILE, folder: str | None = None
) -> ModelSet:
    """Forests of weather, then power, of a clean history."""
    return _fit_chain(training_frame(time_features(history, cyclical=False)), profile, folder)


def _fit_chain(frame: DataFrame, profile: ForestProfile, folder: str | None) -> ModelSet:
    encoder = fit_entity_encoder(frame)
    models = train_chain(encoder.transform(frame), chain_features(encoder.names), profile, folder)
    return ModelSet("chain", models, encoder)


def forecast_chain(
    history: DataFrame,
    fitted: ModelSet,
    entities: str = "all",
    targets: Sequence[str] = DEPENDENCY_ORDER,
) -> DataFrame:
    """Forecast weather, then power, then yields, with models fitted now or before.

    Weather without a model is persisted, power without a model is 0.
    """
    lacking = [c for c in WEATHER if c not in fitted.models]
    if lacking:
        future = persistence_weather(history, lacking, entities)
    else:
        future = entity_spine(history, ENTITY, entities)
    future = fitted.encoder.transform(time_features(future, cyclical=False))
    wanted = [t for t in targets if t not in lacking]
    return _with_yields(predict_chain(future, fitted.models, wanted), history, entities)


def chain_forecast(
    history: DataFrame,
    profile: ForestProfile = CHAIN_PROFILE,
    entities: str = "all",
    targets: Sequence[str] = DEPENDENCY_ORDER,
) -> DataFrame:
    """Fit on a clean history and forecast from its end."""
    frame = training_frame(time_features(history, cyclical=False))
    written = frame.select(*history.columns)
    return forecast_chain(written, _fit_chain(frame, profile, None), entities, targets)


def fit_lag(
    history: DataFrame,
    profile: ForestProfile = LAG_PROFILE,
    by: Sequence[str] = ENTITY,
    cell: str | None = None,
    folder: str | None = None,
) -> ModelSet:
    """Forests of both powers on given weather; ``by=()`` takes lags over all series at once."""
    return _fit_lag(training_frame(history_features(history, by, cell=cell)), profile, folder)


def _fit_lag(frame: DataFrame, profile: ForestProfile, folder: str | None) -> ModelSet:
    encoder = fit_entity_encoder(frame)
    models = train_chain(encoder.transform(frame), lag_features(encoder.names), profile, folder)
    return ModelSet("lag", models, encoder)


def forecast_lag(
    history: DataFrame,
    fitted: ModelSet,
    future_weather: DataFrame | None = None,
    entities: str = "all",
    with_history: bool = False,
    by: Sequence[str] = ENTITY,
) -> DataFrame:
    """Forecast power from given or persisted weather, then yields.

    ``future_weather`` has one row per time of the spine, for all series alike. ``by`` is that of
    the fit; the grid's lags follow it too.
    """
    if future_weather is None:
        future = persistence_weather(history, WEATHER, entities)
    else:
        spine = entity_spine(history, ENTITY, entities)
        future = spine.join(future_weather.select(TIME, *WEATHER), TIME, "left")
    lagged = future_features(future, by, history if with_history else None)
    ready = fitted.encoder.transform(lagged)
    return _with_yields(predict_chain(ready, fitted.models, POWER), history, entities)


def lag_forecast(
    history: DataFrame,
    future_weather: DataFrame | None = None,
    profile: ForestProfile = LAG_PROFILE,
    entities: str = "all",
    with_history: bool = False,
    by: Sequence[str] = ENTITY,
    cell: str | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Fit on a clean history and forecast power, then yields, from its end."""
    frame = training_frame(history_features(history, by, cell=cell))
    written = frame.select(*history.columns)
    return forecast_lag(
        written, _fit_lag(frame, profile, folder), future_weather, entities, with_history, by
    )


def _with_yields(future, history, entities) -> DataFrame:
    return continue_yields(future, history, entities).select(*FORECAST_COLUMNS)


def out_of_bag_scores(
    frame: DataFrame,
    features: dict[str, list[str]],
    profile: ForestProfile = LAG_PROFILE,
    threads: int = TREE_THREADS,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """R2 of each target, every row predicted by the trees whose sample does not hold it.

    ``frame`` is a :func:`training_frame` with encoded keys. Each tree is fitted on its own draw of
    the rows, which follows from their keys, so the rows a tree has not seen are known without
    having been stored. The second result holds the rows, with ``oob_trees`` and the prediction.
    """
    every = sorted({c for names in features.values() for c in names})
    scaler = scaler_for(frame, every, profile)
    rows, scored = [], {}
    # Draws go by the keys, so the partitions of large frames are those that suit the passes over
    # all trees. By content, as a key may repeat.
    count, placed = frame.count(), frame
    if count > ROWS_IN_TASK:
        parts = max(_WIDE_TASKS, -(-count // _TASK_ROWS))
        placed = frame.repartition(parts, *frame.columns).sortWithinPartitions(*ORDER, F.xxhash64(*frame.columns))
    for target, names in features.items():
        names = existing(frame, names)
        if target not in frame.columns or not names or not has_at_least(frame, profile.min_rows):
            continue
        ready = _assembled(placed, names, _only(scaler, names)).select(*ORDER, target, _VECTOR).checkpoint()
        drawn = fit_drawn(ready, _VECTOR, target, profile, ORDER, threads, written=True)
        scored[target] = out_of_bag(ready, drawn, ORDER).drop(_VECTOR)
        found = fit_quality(scored[target], target).first()
        rows.append((target, found["r2"], found["rows"], drawn.trees))
    table = frame.sparkSession.createDataFrame(
        rows, "target string, oob_r2 double, rows bigint, trees int"
    )
    return table, scored


def holdout_r2(
    history: DataFrame, profile: ForestProfile = CHAIN_PROFILE, folds: int = 5
) -> DataFrame:
    """R2 of each chain target on one fold, left out of training by key hash.

    Stands in for the out-of-bag score, which Spark's forests do not have.
    """
    fold = F.pmod(F.xxhash64(*ORDER), F.lit(folds))
    timed = time_features(history, cyclical=False)
    written = training_frame(timed.withColumn("__fold", fold.cast("int")))
    encoder = fit_entity_encoder(written)
    marked = encoder.transform(written)
    features = chain_features(encoder.names)
    train, test = marked.where("__fold > 0"), marked.where("__fold = 0")
    models = train_chain(train, features, profile)
    scores = []
    for target, model in models.items():
        truth = test.withColumn("__truth", F.col(target))
        evaluator = RegressionEvaluator(
            labelCol="__truth", predictionCol=target, metricName="r2"
        )
        scores.append((target, evaluator.evaluate(model.predict(truth))))
    table = written.sparkSession.createDataFrame(
        scores, "target string, holdout_r2 double"
    )
    rows = written.agg(
        F.count_if(F.col("__fold") > 0).alias("train_rows"),
        F.count_if(F.col("__fold") == 0).alias("test_rows"),
    ).first()
    return table.withColumns(
        {
            "train_rows": F.lit(rows["train_rows"]).cast("bigint"),
            "test_rows": F.lit(rows["test_rows"]).cast("bigint"),
        }
    )
