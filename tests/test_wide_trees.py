"""Trees of more rows than a task holds, against those grown whole in one."""

from dataclasses import replace

import numpy as np
import pytest
from helpers import sunny_rows
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from heliodrift.plans import ensembles, forests, wide_trees
from heliodrift.plans.drawn_trees import cuts, grow
from heliodrift.plans.ensembles import fit_drawn, out_of_bag
from heliodrift.plans.forests import LAG_PROFILE, out_of_bag_scores
from heliodrift.plans.wide_trees import WrittenTrees, find_thresholds
from heliodrift.schemas import COMBINED_SCHEMA, ORDER

DEEP = replace(LAG_PROFILE, trees=3, depth=12)
TARGET = "AC_POWER"


@pytest.fixture(scope="module")
def data(spark):
    history = spark.createDataFrame(sunny_rows(days=8), COMBINED_SCHEMA)
    ready = history.withColumns(
        {"x": F.floor("AMBIENT_TEMPERATURE").cast("double"), "y": F.hour("DATE_TIME").cast("double"), "z": F.col("PLANT_ID").cast("double")}
    ).withColumn(TARGET, F.col(TARGET) + F.pmod(F.hash(*ORDER), F.lit(97)))
    return VectorAssembler(inputCols=["x", "y", "z"], outputCol="v").transform(ready).select(*ORDER, TARGET, "v").repartition(3).checkpoint()


def scores(data, drawn):
    rows = out_of_bag(data, drawn, ORDER).orderBy(*ORDER, TARGET).select("oob_trees", "__prediction").collect()
    return [r[0] for r in rows], [r[1] for r in rows]


@pytest.mark.parametrize("most", [200, 20])
def test_wide_trees_score_like_those_of_one_task(data, monkeypatch, most):
    """Few distinct values, so both have every cut between them."""
    counts, guesses = scores(data, fit_drawn(data, "v", TARGET, DEEP, ORDER))
    monkeypatch.setattr(ensembles, "ROWS_IN_TASK", most)
    monkeypatch.setattr(wide_trees, "ROWS_MOVED", data.count() * 2)
    monkeypatch.setattr(wide_trees, "NODES_TOGETHER", 4)
    drawn = fit_drawn(data, "v", TARGET, DEEP, ORDER, written=True)
    assert isinstance(drawn, WrittenTrees) and drawn.trees == 3 and len(drawn.tables) == 2
    assert all(len(t.feature) > 3 for t in drawn.tops)
    found_counts, found = scores(data, drawn)
    assert found_counts == counts and 0 < min(c for c in counts if c)
    assert [g is None for g in found] == [g is None for g in guesses]
    assert [g for g in found if g is not None] == pytest.approx([g for g in guesses if g is not None])


def test_rows_that_agree_in_their_keys_or_lack_them_stay_apart(data, monkeypatch):
    monkeypatch.setattr(ensembles, "ROWS_IN_TASK", 100)
    odd = data.withColumn("SOURCE_KEY", F.when(F.hour("DATE_TIME") > 5, F.col("SOURCE_KEY")))
    twice = odd.unionByName(odd).checkpoint()
    found = out_of_bag(twice, fit_drawn(twice, "v", TARGET, DEEP, ORDER, written=True), ORDER)
    assert found.count() == twice.count() and found.columns == [*twice.columns, "oob_trees", "__prediction"]


def test_equal_rows_and_equal_targets_are_leaves(spark, data, monkeypatch):
    """More rows than a task holds that no feature tells apart."""
    monkeypatch.setattr(ensembles, "ROWS_IN_TASK", 100)
    flat = VectorAssembler(inputCols=["one"], outputCol="f").transform(data.withColumn("one", F.lit(1.0))).checkpoint()
    drawn = fit_drawn(flat, "f", TARGET, DEEP, ORDER, written=True)
    assert [t.feature for t in drawn.tops] == [[-2]] * 3
    mean = data.agg(F.avg(TARGET)).first()[0]
    assert np.allclose([g for g in scores(flat, drawn)[1] if g is not None], mean, rtol=0.1)
    same = data.withColumn(TARGET, F.lit(0.1))
    assert [t.feature for t in fit_drawn(same, "v", TARGET, DEEP, ORDER, written=True).tops] == [[-2]] * 3


def test_a_missing_target_is_refused(data, monkeypatch):
    monkeypatch.setattr(ensembles, "ROWS_IN_TASK", 100)
    with pytest.raises(Exception, match="must not be null"):
        fit_drawn(data.withColumn(TARGET, F.when(F.hour("DATE_TIME") > 3, F.col(TARGET))), "v", TARGET, DEEP, ORDER, written=True)


def test_thresholds_are_those_of_all_rows(spark):
    few = spark.range(9_000, numPartitions=5).select((F.col("id") % 300).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    a, b = find_thresholds(VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(few), "v", 128)
    rows = np.arange(9_000)
    assert a.tolist() == cuts(rows % 300.0, 128).tolist() and b.tolist() == cuts(rows % 7.0, 128).tolist()
    many = spark.range(40_000, numPartitions=3).select(F.col("id").cast("double").alias("a"))
    (found,) = find_thresholds(VectorAssembler(inputCols=["a"], outputCol="v").transform(many), "v", 128)
    assert len(found) == 127 and np.abs(found - cuts(np.arange(40_000.0), 128)).max() < 40_000 / 500


def test_the_scores_of_large_frames_need_no_pass_of_spark(spark, data, monkeypatch):
    """Before, each tree of more rows was fitted by passes over all of them."""

    def fit(*_):
        raise AssertionError("a pass")

    monkeypatch.setattr(ensembles, "ROWS_IN_TASK", 300)
    monkeypatch.setattr(forests, "ROWS_IN_TASK", 300)
    monkeypatch.setattr(forests, "_WIDE_TASKS", 3)
    monkeypatch.setattr(ensembles.RandomForestRegressor, "fit", fit)
    frame = data.select(*ORDER, TARGET, F.hour("DATE_TIME").alias("hour"), F.minute("DATE_TIME").alias("minute")).checkpoint()
    table, scored = out_of_bag_scores(frame, {TARGET: ["hour", "minute"]}, DEEP)
    (row,) = table.collect()
    assert row["trees"] == 3 and row["oob_r2"] > 0.2
    assert row["rows"] == scored[TARGET].where("oob_trees > 0").count() > 700


@pytest.mark.parametrize("dense", [20, 300])
def test_sums_by_bin_give_the_same_tree(dense):
    rng = np.random.default_rng(3)
    binned, weight = rng.integers(0, 60, (3, 4_000)).astype(np.uint8), rng.poisson(1, 4_000)
    target = binned[0] * 2.0 + (binned[1] > 30) * 50 + rng.normal(size=4_000)
    plain, found = (grow(binned, target, weight, 25, 20, d) for d in (None, dense))
    for name in ("feature", "bin", "left", "right", "rows"):
        assert found[name].tolist() == plain[name].tolist()
    assert found["mean"] == pytest.approx(plain["mean"]) and len(found["mean"]) > 100
