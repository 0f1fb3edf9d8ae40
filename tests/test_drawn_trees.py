"""Trees grown in tasks against Spark's own on the same draws."""

from dataclasses import replace

import numpy as np
import pytest
from helpers import sunny_rows
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from heliodrift.plans import ensembles
from heliodrift.plans.drawn_trees import cuts, grow
from heliodrift.plans.ensembles import copies, fit_drawn, fit_groups
from heliodrift.plans.forests import LAG_PROFILE, lag_forecast
from heliodrift.schemas import COMBINED_SCHEMA, ORDER

DEEP = replace(LAG_PROFILE, trees=3, depth=12, group_trees=2)
TARGET = "AC_POWER"


@pytest.fixture(scope="module")
def data(spark):
    history = spark.createDataFrame(sunny_rows(days=8), COMBINED_SCHEMA)
    ready = history.withColumns(
        {"x": F.floor("AMBIENT_TEMPERATURE").cast("double"), "y": F.hour("DATE_TIME").cast("double"), "z": F.col("PLANT_ID").cast("double")}
    ).withColumn(TARGET, F.col(TARGET) + F.pmod(F.hash(*ORDER), F.lit(97)))
    return VectorAssembler(inputCols=["x", "y", "z"], outputCol="v").transform(ready).select(*ORDER, TARGET, "v").repartition(3).checkpoint()


def predictions(model, data):
    rows = model.copy().setPredictionCol("p").transform(data).orderBy(*ORDER).collect()
    return [r["p"] for r in rows]


def test_a_tree_is_the_one_that_spark_grows(data):
    """Few distinct values, so both have every cut between them; compared where a tree was trained."""
    found = fit_drawn(data, "v", TARGET, DEEP, ORDER, threads=2)
    assert len(found.members) == found.trees == 3
    for number, tree in enumerate(found.members):
        drawn = data.withColumn("w", copies(F.lit(number), ORDER).cast("double")).where("w > 0")
        one = ensembles.regressor(DEEP, "v", TARGET, 1, 1).setBootstrap(False).setWeightCol("w").fit(drawn)
        assert predictions(tree, drawn) == pytest.approx(predictions(one, drawn))
        assert tree.numNodes == one.trees[0].numNodes > 50 and tree.depth == one.trees[0].depth


def test_no_pass_of_spark_is_left_for_rows_that_fit_a_task(data, monkeypatch):
    monkeypatch.setattr(ensembles, "regressor", _without_fit(ensembles.regressor))
    assert fit_drawn(data, "v", TARGET, DEEP, ORDER).trees == 3
    assert fit_groups(data, "v", TARGET, DEEP, keys=ORDER).trees == 3
    monkeypatch.setattr(ensembles, "ROWS_IN_TASK", 100)
    with pytest.raises(AssertionError, match="a pass"):
        fit_drawn(data, "v", TARGET, DEEP, ORDER)


def _without_fit(real):
    def made(*args):
        one = real(*args)

        def fit(_):
            raise AssertionError("a pass")

        one.fit = fit
        return one

    return made


def test_groups_do_not_depend_on_partitions_and_can_be_saved(data, tmp_path):
    first = fit_groups(data, "v", TARGET, DEEP, keys=ORDER, threads=2)
    again = fit_groups(data.repartition(7), "v", TARGET, DEEP, keys=ORDER)
    assert [m.getNumTrees for m in first.members] == [2, 1]
    for k, (a, b) in enumerate(zip(first.members, again.members, strict=True)):
        assert predictions(a, data) == predictions(b, data)
        a.save(f"{tmp_path}/{k}")
        assert predictions(RandomForestRegressionModel.load(f"{tmp_path}/{k}"), data) == predictions(a, data)


def test_a_missing_target_is_refused(data):
    with pytest.raises(Exception, match="must not be null"):
        fit_drawn(data.withColumn(TARGET, F.when(F.hour("DATE_TIME") > 3, F.col(TARGET))), "v", TARGET, DEEP, ORDER)


def test_cuts_are_between_values_and_bounded():
    assert cuts(np.array([3.0, 1.0, 1.0]), 128).tolist() == [2.0]
    assert cuts(np.ones(5), 128).tolist() == []
    many = cuts(np.arange(10_000.0), 128)
    assert 120 <= len(many) <= 127 and np.all(np.diff(many) > 0)
    skewed = cuts(np.concatenate((np.zeros(10_000), np.arange(300.0))), 16)
    assert 1 <= len(skewed) <= 15


def test_a_tree_keeps_the_least_rows_of_a_leaf_and_leaves_equal_targets_alone():
    rng = np.random.default_rng(1)
    binned, weight = rng.integers(0, 50, (4, 900)).astype(np.uint8), rng.poisson(1, 900)
    nodes = grow(binned, rng.normal(size=900), weight, 25, 4)
    leaves = nodes["feature"] < 0
    assert nodes["rows"][leaves].min() >= 4 and nodes["rows"][leaves].sum() == np.count_nonzero(weight)
    assert nodes["rows"][~leaves].min() >= 8
    flat = grow(binned, np.full(900, 0.1), weight, 25, 4)
    assert len(flat["feature"]) == 1 and flat["mean"][0] == pytest.approx(0.1)


def test_the_lag_forecast_is_fitted_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(ensembles, "regressor", _without_fit(ensembles.regressor))
    history = spark.createDataFrame(sunny_rows(), COMBINED_SCHEMA)
    assert lag_forecast(history, profile=replace(LAG_PROFILE, trees=3, depth=6)).count() == 192
