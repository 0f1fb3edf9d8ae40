"""Ensembles of trees: fitted in groups that are kept, and scored by the rows a tree did not see."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import TYPE_CHECKING, TypeVar

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodrift.plans.drawn_trees import fit_in_tasks
from heliodrift.plans.wide_trees import ROW, WrittenTrees, binned_rows, fit_wide, guesses_of_the_unseen
from heliodrift.session import shared_folder

if TYPE_CHECKING:
    from heliodrift.plans.forests import ForestProfile

PREDICTION = "__prediction"
WEIGHT = "__weight"
#: Members whose predictions are added up before the sums are written.
SCORED_TOGETHER = 25
#: Rows up to which a tree on a draw of keys is grown in one task; trees of more rows by Spark's passes.
ROWS_IN_TASK = 200_000

# Where 32 random bits pass from a draw of k to one of k + 1 copies, if the number
# of copies of a row in a bootstrap sample is Poisson distributed with mean 1.
_COPIES = [
    math.floor(2**32 * sum(math.exp(-1) / math.factorial(n) for n in range(k + 1)))
    for k in range(12)
]

_A, _B = TypeVar("_A"), TypeVar("_B")


def side_by_side(
    spark: SparkSession, function: Callable[[_A], _B], items: Sequence[_A], threads: int
) -> list[_B]:
    """Results in order. The jobs of several items share the executors, so that the passes of a
    small fit, which wait for each other, leave no cores idle."""
    if threads < 2 or len(items) < 2:
        return [function(x) for x in items]
    with ThreadPool(min(threads, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(function), items, chunksize=1)


@dataclass(frozen=True)
class Ensemble:
    """Forests as one: the mean over all trees. A task holds one member's trees at a time."""

    members: tuple[RandomForestRegressionModel | DecisionTreeRegressionModel, ...]

    @property
    def trees(self) -> int:
        return sum(map(_trees_of, self.members))

    def transform(self, df: DataFrame) -> DataFrame:
        total = F.lit(0.0)
        for k, member in enumerate(self.members):
            df = member.copy().setPredictionCol(f"__member_{k}").transform(df)
            total = total + F.col(f"__member_{k}") * _trees_of(member)
        mean = df.withColumn(PREDICTION, total / self.trees)
        return mean.drop(*[f"__member_{k}" for k in range(len(self.members))])


def _trees_of(member: RandomForestRegressionModel | DecisionTreeRegressionModel) -> int:
    return 1 if isinstance(member, DecisionTreeRegressionModel) else member.getNumTrees


def regressor(profile: ForestProfile, features: str, target: str, trees: int, seed: int) -> RandomForestRegressor:
    """Every feature is tried at every split; node ids are kept beside the rows, so a level does
    not walk down the whole tree again, and checkpointed so that lost executors cost little."""
    return RandomForestRegressor(
        featuresCol=features,
        labelCol=target,
        predictionCol=PREDICTION,
        numTrees=trees,
        maxDepth=profile.depth,
        minInstancesPerNode=profile.min_leaf,
        featureSubsetStrategy="all",
        bootstrap=profile.bootstrap,
        subsamplingRate=1.0,
        maxBins=profile.bins,
        seed=seed,
        maxMemoryInMB=profile.memory_mb,
        cacheNodeIds=True,
        checkpointInterval=10,
    )


def fingerprint(df: DataFrame) -> str:
    """The same for the same rows in any order."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns) % 1_000_000_007).alias("h")).first()
    return f"{row['n']}-{row['h']}"


def fit_groups(
    data: DataFrame,
    features: str,
    target: str,
    profile: ForestProfile,
    folder: str | None = None,
    threads: int = 1,
    keys: Sequence[str] = (),
) -> Ensemble:
    """A forest fitted ``profile.group_trees`` trees at a time, each group with a seed of its own.

    With ``profile.by_keys`` and ``keys`` each tree has its own draw of ``copies`` and is grown in a
    task, up to ``ROWS_IN_TASK`` rows; the passes of more rows draw by the rows' places.

    With a ``folder`` each group is written when it is ready, and a later call with the same rows,
    features and profile goes on after the last one: what a lost driver had fitted is read.
    """
    size = profile.group_trees or profile.trees
    starts = list(range(0, profile.trees, size))
    wanted = f"{profile}|{target}|{fingerprint(data)}" if folder else ""
    in_tasks = profile.by_keys and profile.bootstrap and bool(keys) and data.count() <= ROWS_IN_TASK

    def draws(number: Column) -> Column:
        return copies(F.concat_ws("-", F.lit(profile.seed).cast("string"), number.cast("string")), keys)

    def group(start: int) -> RandomForestRegressionModel:
        place = f"{folder}/{target}-{start}"
        if folder and _mark(data, f"{place}.done") == wanted:
            return RandomForestRegressionModel.load(place)
        trees = min(size, profile.trees - start)
        one = regressor(profile, features, target, trees, profile.seed + start)
        if in_tasks:
            model = fit_in_tasks(data, features, target, profile, one, draws, start, trees)
        else:
            model = one.fit(data)
        if folder:
            model.write().overwrite().save(place)
            # Last, so that a group which is only half written counts for nothing.
            mark = data.sparkSession.createDataFrame([(wanted,)], "mark string")
            mark.coalesce(1).write.mode("overwrite").parquet(f"{place}.done")
        return model

    return Ensemble(tuple(side_by_side(data.sparkSession, group, starts, threads)))


def _mark(data: DataFrame, path: str) -> str | None:
    try:
        return data.sparkSession.read.schema("mark string").parquet(path).first()["mark"]
    except AnalysisException:  # no such path
        return None


def copies(tree: Column, keys: Sequence[str]) -> Column:
    """How often a tree's bootstrap sample holds a row: a Poisson draw by a digest of both.

    It follows from the row's keys alone, wherever the row lies and however often a task runs.
    Rows that agree in all keys are drawn together.
    """
    bits = _bits(tree, keys)
    return sum(((bits >= limit).cast("int") for limit in _COPIES), F.lit(0))


def unseen(tree: Column, keys: Sequence[str]) -> Column:
    """Whether a tree's sample has no copy of a row."""
    return _bits(tree, keys) < _COPIES[0]


def _bits(tree: Column, keys: Sequence[str]) -> Column:
    name = F.concat_ws("|", tree.cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("bigint")


def fit_drawn(
    data: DataFrame,
    features: str,
    target: str,
    profile: ForestProfile,
    keys: Sequence[str],
    threads: int = 1,
    written: bool = False,
) -> Ensemble | WrittenTrees:
    """As many single trees as the profile has, each on its own draw of ``copies``.

    Up to ``ROWS_IN_TASK`` rows each is grown in a task. Trees of more rows are grown by Spark's
    passes, or, if they may stay ``written``, in tasks of no more rows; those go to ``out_of_bag``.
    """

    def some(start: int) -> list[DecisionTreeRegressionModel]:
        trees = min(SCORED_TOGETHER, profile.trees - start)
        model = regressor(profile, features, target, trees, profile.seed + start)
        return fit_in_tasks(data, features, target, profile, model, lambda n: copies(n, keys), start, trees).trees

    if data.count() <= ROWS_IN_TASK:
        found = side_by_side(data.sparkSession, some, range(0, profile.trees, SCORED_TOGETHER), threads)
        return Ensemble(tuple(tree for group in found for tree in group))
    if written:
        numbered = data.withColumn(ROW, F.monotonically_increasing_id())
        return fit_wide(numbered, features, target, profile, _all_bits(profile.trees, keys), _COPIES, ROWS_IN_TASK)

    def tree(number: int) -> RandomForestRegressionModel:
        drawn = data.withColumn(WEIGHT, copies(F.lit(number), keys).cast("double")).where(F.col(WEIGHT) > 0)
        one = regressor(profile, features, target, 1, profile.seed + number)
        # Walking down one tree costs less than keeping the node of every row.
        return one.setBootstrap(False).setCacheNodeIds(False).setWeightCol(WEIGHT).fit(drawn)

    return Ensemble(tuple(side_by_side(data.sparkSession, tree, range(profile.trees), threads)))


def _all_bits(trees: int, keys: Sequence[str]) -> Column:
    """The bits of all trees, in order."""
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda n: _bits(n, keys))


def out_of_bag(data: DataFrame, drawn: Ensemble | WrittenTrees, keys: Sequence[str]) -> DataFrame:
    """``data`` with ``oob_trees``, the trees that did not draw a row, and their mean prediction.

    A row that every tree drew has none.
    """
    shared_folder(data.sparkSession)
    names = data.columns
    mean = F.when(F.col("oob_trees") > 0, F.col("__sum") / F.col("oob_trees"))
    if isinstance(drawn, WrittenTrees):
        numbered = data.withColumn(ROW, F.monotonically_increasing_id()).checkpoint()
        rows = binned_rows(numbered, drawn.features, drawn.thresholds, _all_bits(drawn.trees, keys), _COPIES)
        guessed = numbered.join(guesses_of_the_unseen(rows, drawn), ROW, "left")
        # Written, or each use would score the rows again.
        table = guessed.select(*names, "__sum", F.coalesce("oob_trees", F.lit(0)).alias("oob_trees")).checkpoint()
        return table.withColumn(PREDICTION, mean).drop("__sum")
    table = data.withColumns({"__sum": F.lit(0.0), "oob_trees": F.lit(0)})
    for start in range(0, len(drawn.members), SCORED_TOGETHER):
        total, count = F.col("__sum"), F.col("oob_trees")
        for number in range(start, min(start + SCORED_TOGETHER, len(drawn.members))):
            guess = f"__member_{number}"
            table = drawn.members[number].copy().setPredictionCol(guess).transform(table)
            left_out = unseen(F.lit(number), keys)
            total = total + F.when(left_out, F.col(guess)).otherwise(0.0)
            count = count + left_out.cast("int")
        # Written, or the plan would grow with the number of trees.
        table = table.select(*names, total.alias("__sum"), count.alias("oob_trees")).checkpoint()
    return table.withColumn(PREDICTION, mean).drop("__sum")


def fit_quality(scored: DataFrame, target: str, prediction: str = PREDICTION) -> DataFrame:
    """R2 over the rows with a prediction, in one aggregation; null if the target does not vary."""
    off = F.sum(F.pow(F.col(target) - F.col(prediction), 2))
    spread = F.var_pop(target) * F.count(target)
    return scored.where(F.col(prediction).isNotNull()).agg(
        F.when(spread > 0, 1 - off / spread).alias("r2"), F.count(target).alias("rows")
    )
