"""Trees on draws of the rows' keys, grown side by side in tasks of bounded rows.

Spark's forests hold split statistics of every bin for every node, so a deep tree of a few rows a
leaf costs the bins times its nodes, and that once for each task of a pass. Here a task gets the
rows of a frame that fits one, and grows a few trees on them; the statistics of a node are read off
its own rows in the order of the bins. The rules are those of Spark's trees: all features at each
split, binned thresholds, variance, the least rows of a leaf, ties to the first feature and bin.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliodrift.session import scratch_path

if TYPE_CHECKING:
    from heliodrift.plans.forests import ForestProfile

#: Trees that a task grows on the same rows.
TREES_TOGETHER = 5
_NODES = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>,"
    " rawCount bigint, gain double, leftChild int, rightChild int,"
    " split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between distinct values; of more than ``bins`` values, those at even shares of the rows."""
    return spread(*np.unique(values, return_counts=True), bins)


def spread(distinct: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """The same for distinct values in order and the rows that have them."""
    before = np.arange(len(distinct) - 1)
    if len(distinct) > bins:
        shares = np.arange(1, bins) * (counts.sum() / bins)
        before = np.unique(np.searchsorted(np.cumsum(counts), shares))
        before = before[before < len(distinct) - 1]
    return (distinct[before] + distinct[before + 1]) / 2


def grow(
    binned: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, min_leaf: int, dense: int | None = None
) -> dict[str, np.ndarray]:
    """Nodes of one tree, a level after another; ``binned`` has a row for each feature.

    ``bin`` is the last one that goes to the left; a leaf has the feature -1. ``min_leaf`` counts
    rows, however often they were drawn. While nodes have ``dense`` rows on average, sums are taken
    by bin and not along the sorted rows, which is faster and differs by rounding.
    """
    rows = np.flatnonzero(weight)
    w, y = weight[rows].astype(float), target[rows]
    centre = np.average(y, weights=w)
    y = y - centre
    wy = w * y
    features = np.ascontiguousarray(binned[:, rows])
    node = np.zeros(len(rows), np.int64)
    by_bin = dense is not None and len(rows) >= dense
    # For each feature the open rows by node, then bin. At first there is one node.
    orders = [np.arange(len(rows))] if by_bin else [np.argsort(f, kind="stable") for f in features]
    bins = max(2, int(binned.max(initial=0)) + 1)
    out: list[dict[str, np.ndarray]] = []
    ids = 0
    for level in range(depth + 1):
        members = orders[0]
        count = np.bincount(node[members])
        if by_bin and len(members) < dense * len(count):
            by_bin = False
            cells = node[members] * bins
            orders = [members[np.argsort(cells + f[members], kind="stable")] for f in features]
            members = orders[0]
        start = np.cumsum(count) - count
        mass = np.bincount(node[members], w[members])
        total = np.bincount(node[members], wy[members])
        squares = np.bincount(node[members], (wy * y)[members])
        size = len(count)
        mean = total / mass
        best = {"gain": np.zeros(size), "feature": np.full(size, -1), "bin": np.zeros(size, np.int64)}
        if level < depth and by_bin:
            best = _best_by_bin(features, members, node, (w, wy), (count, mass, total, squares), bins, min_leaf)
        elif level < depth:
            mixed = np.minimum.reduceat(y[members], start) < np.maximum.reduceat(y[members], start)
            owner = np.repeat(np.arange(size), count)
            place = np.arange(len(members)) - start[owner] + 1
            # A cut behind this row leaves enough rows on both sides.
            allowed = (place >= min_leaf) & (count[owner] - place >= min_leaf) & mixed[owner]
            allowed[-1] = False
            possible = np.flatnonzero(allowed)
            base = total * total / mass
            for k, order in enumerate(orders):
                values = features[k][order]
                here = possible[values[possible] < values[possible + 1]] if len(possible) else possible
                if not len(here):
                    continue
                at = owner[here]
                heavy, sums = np.cumsum(w[order]), np.cumsum(wy[order])
                first = start[at]
                left = heavy[here] - np.where(first > 0, heavy[first - 1], 0)
                left_sum = sums[here] - np.where(first > 0, sums[first - 1], 0)
                rest, rest_sum = mass[at] - left, total[at] - left_sum
                gain = left_sum * left_sum / left + rest_sum * rest_sum / rest - base[at]
                heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                nodes = at[heads]
                top = np.maximum.reduceat(gain, heads)
                # The first place of the largest gain in each node.
                widths = np.diff(np.concatenate((heads, [len(at)])))
                peaks = np.flatnonzero(gain == np.repeat(top, widths))
                peaks = peaks[np.searchsorted(peaks, heads)]
                better = top > np.maximum(best["gain"][nodes], 1e-12 * squares[nodes])
                nodes, peaks = nodes[better], peaks[better]
                best["gain"][nodes] = gain[peaks]
                best["feature"][nodes] = k
                best["bin"][nodes] = values[here[peaks]]
        split = best["feature"] >= 0
        children = np.cumsum(split) - 1
        left_id = np.where(split, ids + size + 2 * children, -1)
        out.append(
            best
            | {"left": left_id, "right": np.where(split, left_id + 1, -1), "mean": mean + centre, "rows": count}
            | {"mass": mass, "total": total, "squares": squares, "variance": np.maximum(squares / mass - mean * mean, 0)}
        )
        ids += size
        if not split.any():
            break
        # Rows of a split go on to its children; the order by bin within a node is kept.
        goes = features[best["feature"][node[members]], members] > best["bin"][node[members]]
        to = np.full(len(rows), -1, np.int64)
        to[members] = np.where(split[node[members]], 2 * children[node[members]] + goes, -1)
        counts = np.bincount(to[to >= 0], minlength=2 * int(split.sum()))
        offsets = np.cumsum(counts) - counts
        if by_bin:
            orders, node = [members[to[members] >= 0]], to
            continue
        # Of a node's rows, those to the left come first, so the sums over all rows give places.
        firsts = offsets[::2]
        kept = members[to[members] >= 0]
        parents = to[kept] // 2
        for k, order in enumerate(orders):
            order = order[to[order] >= 0]
            right = to[order] & 1
            before = np.cumsum(right) - right
            ranks = before - before[firsts][parents]
            along = np.arange(len(order)) - firsts[parents]
            places = np.where(right == 1, offsets[1::2][parents] + ranks, firsts[parents] + along - ranks)
            orders[k] = np.empty_like(order)
            orders[k][places] = order
        node = to
    return {c: np.concatenate([x[c] for x in out]) for c in out[0]}


def _best_by_bin(
    features: np.ndarray,
    members: np.ndarray,
    node: np.ndarray,
    weights: tuple[np.ndarray, np.ndarray],
    sums: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray],
    bins: int,
    min_leaf: int,
) -> dict[str, np.ndarray]:
    """The best split of each node, from the sums of its bins."""
    count, mass, total, squares = sums
    size = len(count)
    best = {"gain": np.zeros(size), "feature": np.full(size, -1), "bin": np.zeros(size, np.int64)}
    cells, (w, wy) = node[members] * bins, (x[members] for x in weights)

    def below(cell: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
        return np.cumsum(np.bincount(cell, weight, size * bins).reshape(size, bins), axis=1)[:, :-1]

    for k, values in enumerate(features):
        cell = cells + values[members]
        rows, left, left_sum = (below(cell, x) for x in (None, w, wy))
        rest, rest_sum = mass[:, None] - left, total[:, None] - left_sum
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_sum * left_sum / left + rest_sum * rest_sum / rest - (total * total / mass)[:, None]
        gain[(rows < min_leaf) | (count[:, None] - rows < min_leaf)] = -np.inf
        # The first place of the largest gain in each node.
        peaks = gain.argmax(axis=1)
        top = gain[np.arange(size), peaks]
        better = top > np.maximum(best["gain"], 1e-12 * squares)
        best["gain"][better], best["feature"][better], best["bin"][better] = top[better], k, peaks[better]
    return best


def _table(number: int, nodes: dict[str, np.ndarray], thresholds: list[np.ndarray], centre: float) -> pa.Table:
    """Nodes of a tree as Spark's models keep them."""
    inner = nodes["feature"] >= 0
    size = len(inner)
    limits = np.array([thresholds[k][b] for k, b in zip(nodes["feature"][inner], nodes["bin"][inner], strict=True)])
    split = pa.StructArray.from_arrays(
        [
            pa.array(nodes["feature"], pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(inner))), pa.int32()), pa.array(limits, pa.float64())),
            pa.array(np.full(size, -1), pa.int32()),
        ],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    stats = np.column_stack((nodes["mass"], nodes["total"], nodes["squares"]))
    stats[:, 2] += 2 * centre * stats[:, 1] + centre * centre * stats[:, 0]
    stats[:, 1] += centre * stats[:, 0]
    columns = {
        "id": pa.array(np.arange(size), pa.int32()),
        "prediction": pa.array(nodes["mean"]),
        "impurity": pa.array(nodes["variance"]),
        "impurityStats": pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * 3, pa.int32()), pa.array(stats.ravel())),
        "rawCount": pa.array(nodes["rows"], pa.int64()),
        "gain": pa.array(np.where(inner, nodes["gain"] / nodes["mass"], -1.0)),
        "leftChild": pa.array(nodes["left"], pa.int32()),
        "rightChild": pa.array(nodes["right"], pa.int32()),
        "split": split,
    }
    data = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.table({"treeID": pa.array(np.full(size, number), pa.int32()), "nodeData": data})


def fit_in_tasks(
    data: DataFrame,
    features: str,
    target: str,
    profile: ForestProfile,
    model: RandomForestRegressor,
    draws: Callable[[Column], Column],
    first: int,
    trees: int,
) -> RandomForestRegressionModel:
    """The trees from number ``first`` on, of rows that fit a task, as a forest of Spark.

    ``draws`` gives how often a tree holds a row. The nodes are written as tasks make them, in the
    layout of a saved forest, which is then loaded.
    """
    spark = data.sparkSession
    batches = -(-trees // TREES_TOGETHER)
    label = F.col(target).cast("double")
    bad = label.isNull() | F.isnan(label)
    dealt = data.select(
        F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("__batch"),
        "*",
    ).repartitionByRange(batches, "__batch")
    numbers = [F.col("__batch") * TREES_TOGETHER + F.lit(first + j) for j in range(TREES_TOGETHER)]
    rows = dealt.select(
        F.col("__batch").alias("batch"),
        # Rows are added up in the same order wherever they come from.
        F.xxhash64(*[F.col(c) for c in data.columns if c != features], vector_to_array(features)).alias("place"),
        vector_to_array(features).alias("x"),
        F.when(bad, F.raise_error(F.lit(f"{target} must not be null or NaN"))).otherwise(label).alias("y"),
        F.array(*[draws(n).cast("int") for n in numbers]).alias("copies"),
    )
    bins, depth, min_leaf = profile.bins, profile.depth, profile.min_leaf

    def run(table: pa.Table) -> pa.Table:
        flat = table.combine_chunks()
        order = np.argsort(flat["place"].to_numpy(), kind="stable")
        x = flat["x"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order].T
        drawn = flat["copies"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order].T
        y = flat["y"].to_numpy()[order]
        thresholds = [cuts(f, bins) for f in x]
        kind = np.uint8 if bins <= 256 else np.int32
        binned = np.array([np.searchsorted(c, f) for c, f in zip(thresholds, x, strict=True)]).astype(kind)
        start, out = flat["batch"][0].as_py() * TREES_TOGETHER, []
        for j, weight in enumerate(drawn[: trees - start]):
            # A sample without a row stands for all of them.
            weight = weight if weight.any() else np.ones_like(weight)
            nodes = grow(binned, y, weight, depth, min_leaf)
            out.append(_table(start + j, nodes, thresholds, float(np.average(y[weight > 0], weights=weight[weight > 0]))))
        return pa.concat_tables(out)

    place = scratch_path(spark, "trees")
    rows.groupBy("batch").applyInArrow(run, _NODES).write.parquet(f"{place}/data")
    width = data.select(F.size(vector_to_array(features)).alias("n")).first()["n"]
    _describe(spark, place, model, width, trees)
    return RandomForestRegressionModel.load(place)


def _describe(spark, place: str, model: RandomForestRegressor, width: int, trees: int) -> None:
    """The descriptions that Spark keeps beside the nodes of a forest."""
    package = "org.apache.spark.ml.regression"
    values = {p.name: (v, model.isSet(p)) for p, v in model.extractParamMap().items()}
    of_forests = ("bootstrap", "featureSubsetStrategy", "numTrees", "subsamplingRate")

    def settings(skipped: Sequence[str] = ()) -> dict[str, dict]:
        kept = {k: x for k, x in values.items() if k not in skipped}
        return {
            "paramMap": {k: v for k, (v, given) in kept.items() if given},
            "defaultParamMap": {k: v for k, (v, given) in kept.items() if not given},
        }

    common = {"timestamp": 0, "sparkVersion": spark.version}
    forest = {"class": f"{package}.RandomForestRegressionModel", "uid": model.uid, "numFeatures": width, "numTrees": trees}
    one = {"class": f"{package}.DecisionTreeRegressionModel"} | settings(of_forests)
    text = json.dumps(common | forest | settings())
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{place}/metadata")
    rows = [(k, json.dumps(common | one | {"uid": f"{model.uid}_{k}"}), 1.0) for k in range(trees)]
    spark.createDataFrame(rows, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{place}/treesMetadata")
