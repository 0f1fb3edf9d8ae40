"""Fitted models kept between runs: written once, read by every forecast.

A version is a folder of Spark ML models (the members of each ensemble, the key encoder) and a
manifest with, for each target, its ordered features, the scaling and its members. The manifest is
written last: a version without one is no version, so a driver lost in between leaves nothing
that could be read. Versions are numbered; the newest complete one is read by default.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodrift.operators.encode import EntityEncoder, Scaler
from heliodrift.plans.ensembles import Ensemble
from heliodrift.plans.forests import ModelSet, TargetModel

_MANIFEST = "version bigint, kind string, encoded array<string>, place string, target string, position int, features array<string>, means string, deviations string, members array<string>"


class NoModels(LookupError):
    """The folder holds no complete version, or not the one asked for."""


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions, oldest first."""
    try:
        manifest = spark.read.schema(_MANIFEST).json(f"{folder}/manifests")
        return [r["version"] for r in manifest.select("version").distinct().orderBy("version").collect()]
    except AnalysisException:  # nothing was saved yet
        return []


def save(spark: SparkSession, fitted: ModelSet, folder: str) -> int:
    """Write a set of models as the next version and return its number."""
    version = max(versions(spark, folder), default=0) + 1
    place = f"models/{version}"
    fitted.encoder.vectors.write().overwrite().save(f"{folder}/{place}/encoder")
    rows = []
    for position, (target, model) in enumerate(fitted.models.items()):
        members = []
        for number, member in enumerate(model.forest.members):
            members.append(f"{place}/{target}/{number}")
            member.write().overwrite().save(f"{folder}/{members[-1]}")
        # Text keeps every bit of a double.
        means, deviations = json.dumps(model.scaler.means), json.dumps(model.scaler.deviations)
        rows.append(
            (version, fitted.kind, list(fitted.encoder.names), place, target, position, list(model.features), means, deviations, members)
        )
    if not rows:  # a set without models is a set too: it persists weather and gives no power
        rows.append((version, fitted.kind, list(fitted.encoder.names), place, None, 0, [], "{}", "{}", []))
    # One small file, in one task, after everything it names.
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifests")
    return version


def load(spark: SparkSession, folder: str, version: int | None = None) -> ModelSet:
    """The models of a version, by default of the newest one."""
    known = versions(spark, folder)
    version = max(known, default=None) if version is None else version
    if version is None or version not in known:
        raise NoModels(f"no version {version or ''} of models in {folder}")
    manifest = spark.read.schema(_MANIFEST).json(f"{folder}/manifests").where(F.col("version") == version)
    rows = manifest.orderBy("position").collect()  # a row for each target
    models = {
        row["target"]: TargetModel(
            row["target"],
            tuple(row["features"]),
            Scaler(json.loads(row["means"]), json.loads(row["deviations"])),
            Ensemble(tuple(RandomForestRegressionModel.load(f"{folder}/{m}") for m in row["members"])),
        )
        for row in rows
        if row["target"] is not None
    }
    vectors = PipelineModel.load(f"{folder}/{rows[0]['place']}/encoder")
    return ModelSet(rows[0]["kind"], models, EntityEncoder(tuple(rows[0]["encoded"]), vectors))


def feature_table(spark: SparkSession, fitted: ModelSet) -> DataFrame:
    """One row for each feature of each model, in the order in which it is read."""
    rows: Sequence[tuple] = [
        (target, k, name, model.scaler.means.get(name), model.scaler.deviations.get(name))
        for target, model in fitted.models.items()
        for k, name in enumerate(model.features)
    ]
    return spark.createDataFrame(
        rows, "target string, position int, feature string, mean double, deviation double"
    )
