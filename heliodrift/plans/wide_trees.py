"""Trees on draws of the rows' keys, of more rows than a task holds.

The upper nodes of a tree are split by histograms, which tasks add up over their rows and which meet
by tree and node. A node that is down to the rows of a task goes on in one: its rows meet there, and
``grow`` does the rest. The rules are those of ``drawn_trees``, so are the trees. They stay in a
table, and rows are scored where they meet the part of the tree that they lead to.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliodrift.plans.drawn_trees import grow, spread
from heliodrift.session import scratch_path

if TYPE_CHECKING:
    from heliodrift.plans.forests import ForestProfile

#: Rows of a pass, for each tree those it takes, that are moved by one job.
ROWS_MOVED = 60_000_000
#: Nodes whose histograms a task adds up at the same time.
NODES_TOGETHER = 400
#: Values of a feature, each with its share of the rows, that stand for a partition with more.
_KEPT = 2048
#: Rows of a node, on average, down to which a task adds up by bin.
DENSE = 128
# What a node without a split is: the root of a part grown in a task, or a leaf.
_GOES_ON, _LEAF = -1, -2

ROW = "__row"
_NODE_LISTS = "feature array<int>, bin array<int>, left array<int>, mean array<double>"


@dataclass
class Top:
    """Upper nodes of a tree, the root first; a right child follows its left one."""

    feature: list[int] = field(default_factory=lambda: [_GOES_ON])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    level: list[int] = field(default_factory=lambda: [0])
    mean: list[float] = field(default_factory=lambda: [0.0])

    def descend(self, x: np.ndarray) -> np.ndarray:
        return descend(np.array(self.feature), np.array(self.bin), np.array(self.left), x)


@dataclass(frozen=True)
class WrittenTrees:
    """Trees whose upper nodes are here, and the rest of whose nodes is in tables."""

    features: str
    thresholds: list[np.ndarray]
    tops: tuple[Top, ...]
    tables: tuple[str, ...]

    @property
    def trees(self) -> int:
        return len(self.tops)


def descend(feature: np.ndarray, bins: np.ndarray, left: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The node at which each row ends; ``x`` has a row for each feature."""
    node = np.zeros(x.shape[1], np.int64)
    inside = np.flatnonzero(feature[node] >= 0)
    while len(inside):
        at = node[inside]
        node[inside] = left[at] + (x[feature[at], inside] > bins[at])
        inside = inside[feature[node[inside]] >= 0]
    return node


def _lists(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).T


def _bytes(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """Binary values of one length as an array with a column for each of them."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    start, end = (np.frombuffer(flat.buffers()[1], np.int32)[flat.offset + k] for k in (0, len(flat)))
    values = np.frombuffer(flat.buffers()[2], np.uint8)[start:end]
    return values.view(kind).reshape(len(flat), -1).T


def _binary(values: np.ndarray) -> pa.Array:
    """The reverse: a binary value for each column."""
    plain = np.ascontiguousarray(values.T)
    size = plain.itemsize * plain.shape[1]
    offsets = np.arange(len(plain) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(plain), [None, pa.py_buffer(offsets), pa.py_buffer(plain)])


def _kind(thresholds: Sequence[np.ndarray]) -> type:
    return np.uint8 if max(map(len, thresholds)) < 256 else np.int32


def find_thresholds(data: DataFrame, features: str, bins: int) -> list[np.ndarray]:
    """``cuts`` of each feature over all rows.

    Up to 2,048 values of a feature in a partition they are exact, beyond that shares are off by a
    2,048th of the rows at most.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_lists(b["x"], b.num_rows) for b in batches if b.num_rows]
        if not parts:
            return
        for k, values in enumerate(np.concatenate(parts, axis=1)):
            distinct, counts = np.unique(values, return_counts=True)
            if len(distinct) > _KEPT:
                upto = np.cumsum(counts)
                ends = np.searchsorted(upto, np.arange(1, _KEPT + 1) * (len(values) / _KEPT))
                ends = np.unique(np.minimum(ends, len(distinct) - 1))
                distinct, counts = distinct[ends], np.diff(upto[ends], prepend=0)
            yield pa.RecordBatch.from_pydict({"k": pa.array([k] * len(distinct), pa.int32()), "value": distinct, "rows": counts})

    def merge(table: pa.Table) -> pa.Table:
        distinct, place = np.unique(table["value"].to_numpy(), return_inverse=True)
        found = spread(distinct, np.bincount(place, table["rows"].to_numpy()), bins)
        return pa.table({"k": pa.array([table["k"][0].as_py()], pa.int32()), "cuts": pa.array([found], pa.list_(pa.float64()))})

    values = data.select(vector_to_array(features).alias("x")).mapInArrow(summary, "k int, value double, rows bigint")
    found = values.groupBy("k").applyInArrow(merge, "k int, cuts array<double>").collect()
    return [np.array(r["cuts"], float) for r in sorted(found, key=lambda r: r["k"])]


def binned_rows(
    data: DataFrame,
    features: str,
    thresholds: Sequence[np.ndarray],
    bits: Column,
    limits: Sequence[int],
    target: Column | None = None,
) -> DataFrame:
    """Rows with their bins, and for each tree how often it holds them, as bytes.

    ``bits`` has the random bits of each tree; every one of the ``limits`` that they reach is a copy.
    """
    kind, steps = _kind(thresholds), np.array(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _lists(batch["x"], batch.num_rows)
            binned = np.array([np.searchsorted(c, v) for c, v in zip(thresholds, x, strict=True)]).astype(kind)
            drawn = np.searchsorted(steps, _lists(batch["bits"], batch.num_rows), side="right").astype(np.uint8)
            yield pa.RecordBatch.from_pydict({ROW: batch[ROW], "x": _binary(binned), "y": batch["y"], "copies": _binary(drawn)})

    y = F.lit(0.0) if target is None else target
    ready = data.select(ROW, vector_to_array(features).alias("x"), y.alias("y"), bits.alias("bits"))
    return ready.mapInArrow(run, f"{ROW} bigint, x binary, y double, copies binary").checkpoint()


def _split(rows: DataFrame, tops: Sequence[Top], nodes: Sequence[tuple[int, int]], sizes: Sequence[int], kind: type, centre: float, min_leaf: int) -> list:
    """The best split of each of the nodes, with the drawn rows on both of its sides."""
    width, bins = len(sizes), max(1, *sizes) + 1
    of_tree: dict[int, list[int]] = {}
    for slot, (tree, _) in enumerate(nodes):
        of_tree.setdefault(tree, []).append(slot)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(nodes), width, bins, 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, copies = _bytes(batch["x"], kind), _bytes(batch["copies"], np.uint8)
            x, y = np.ascontiguousarray(x), batch["y"].to_numpy() - centre
            for tree, slots in of_tree.items():
                place = np.full(len(tops[tree].feature), -1)
                place[[nodes[s][1] for s in slots]] = np.arange(len(slots))
                at = place[tops[tree].descend(x)]
                taken = np.flatnonzero((copies[tree] > 0) & (at >= 0))
                w = copies[tree][taken].astype(float)
                wy, base = w * y[taken], at[taken] * bins
                size = len(slots) * bins
                first = slots[0]
                for k in range(width):
                    cell = base + x[k][taken]
                    for j, weight in enumerate((None, w, wy)):
                        sums[first : first + len(slots), k, :, j] += np.bincount(cell, weight, size).reshape(len(slots), bins)
        part = TaskContext.get().partitionId()
        for slot, (tree, node) in enumerate(nodes):
            value = _binary(sums[slot].reshape(-1, 1))
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "part": pa.array([part], pa.int32()), "sums": value})

    def best(key: tuple, table: pa.Table) -> pa.Table:
        # Added up in the same order wherever they come from.
        values = table.sort_by("part")["sums"]
        sums = np.zeros((width, bins, 3))
        for value in values:
            sums += np.frombuffer(value.as_buffer(), float).reshape(sums.shape)
        count, mass, total = sums[0].sum(axis=0)
        left = np.cumsum(sums, axis=1)[:, :-1]
        rest = np.array([count, mass, total]) - left
        allowed = (left[..., 0] >= min_leaf) & (rest[..., 0] >= min_leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[..., 2] ** 2 / left[..., 1] + rest[..., 2] ** 2 / rest[..., 1] - total * total / mass
        gain = np.where(allowed, gain, -np.inf)
        feature, cut = np.unravel_index(np.argmax(gain), gain.shape)
        # A gain that is only rounding is none; the sums of squares are at least this.
        if not gain[feature, cut] > 1e-12 * (total * total / mass):
            feature, cut = _LEAF, 0
        sides = [float(s[max(feature, 0), cut, 0]) for s in (left, rest)]
        row = {"feature": feature, "bin": cut, "below": sides[0], "above": sides[1], "mean": total / mass + centre}
        return pa.Table.from_pylist([{"tree": key[0].as_py(), "node": key[1].as_py()} | {n: v.item() if hasattr(v, "item") else v for n, v in row.items()}], _BEST)

    partial = rows.mapInArrow(add_up, "tree int, node int, part int, sums binary")
    return partial.groupBy("tree", "node").applyInArrow(best, "tree int, node int, feature int, bin int, below double, above double, mean double").collect()


_BEST = pa.schema(
    [("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("below", pa.float64()), ("above", pa.float64()), ("mean", pa.float64())]
)


def _grow_tops(rows: DataFrame, trees: int, thresholds: Sequence[np.ndarray], profile: ForestProfile, most: int) -> tuple[Top, ...]:
    """Upper nodes of each tree, down to nodes of ``most`` rows."""
    tops = tuple(Top() for _ in range(trees))
    sizes = [len(c) for c in thresholds]
    kind = _kind(thresholds)
    centre = rows.agg(F.avg("y")).first()[0]
    larger = [(tree, 0) for tree in range(trees)]
    while larger:
        found = []
        for start in range(0, len(larger), NODES_TOGETHER):
            some = larger[start : start + NODES_TOGETHER]
            found += _split(rows, tops, some, sizes, kind, centre, profile.min_leaf)
        larger = []
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            top, node = tops[r["tree"]], r["node"]
            level = top.level[node] + 1
            top.mean[node] = r["mean"]
            if r["feature"] == _LEAF or level > profile.depth:
                top.feature[node] = _LEAF
                continue
            top.feature[node], top.bin[node], top.left[node] = r["feature"], r["bin"], len(top.feature)
            for side in ("below", "above"):
                if r[side] > most:
                    larger.append((r["tree"], len(top.feature)))
                top.feature.append(_GOES_ON)
                top.bin.append(0)
                top.left.append(-1)
                top.level.append(level)
                top.mean.append(0.0)
    return tops


def _batches_of(trees: int, rows: int) -> list[range]:
    size = max(1, min(trees, ROWS_MOVED // max(rows, 1)))
    return [range(s, min(s + size, trees)) for s in range(0, trees, size)]


def _parts(tops: Sequence[Top], some: range) -> int:
    """Groups of rows by tree and node; more partitions would be empty."""
    return sum(f == _GOES_ON for t in some for f in tops[t].feature) or 1


def fit_wide(
    data: DataFrame,
    features: str,
    target: str,
    profile: ForestProfile,
    bits: Column,
    limits: Sequence[int],
    most: int,
) -> WrittenTrees:
    """As many trees as the profile has; ``data`` has its rows numbered in ``__row``."""
    label = F.col(target).cast("double")
    checked = F.when(label.isNull() | F.isnan(label), F.raise_error(F.lit(f"{target} must not be null or NaN"))).otherwise(label)
    thresholds = find_thresholds(data, features, profile.bins)
    rows = binned_rows(data, features, thresholds, bits, limits, checked)
    tops = _grow_tops(rows, profile.trees, thresholds, profile, most)
    kind, depth, min_leaf = _kind(thresholds), profile.depth, profile.min_leaf

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        tree, node = key[0].as_py(), key[1].as_py()
        table = table.sort_by(ROW)
        x, y = np.ascontiguousarray(_bytes(table["x"], kind)), table["y"].to_numpy()
        nodes = grow(x, y, table["copies"].to_numpy(), depth - tops[tree].level[node], min_leaf, DENSE)
        lists = {"feature": (nodes["feature"], pa.int32()), "bin": (nodes["bin"], pa.int32()), "left": (nodes["left"], pa.int32()), "mean": (nodes["mean"], pa.float64())}
        return pa.table(
            {"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32())}
            | {n: pa.array([v], pa.list_(t)) for n, (v, t) in lists.items()}
        )

    tables = []
    for some in _batches_of(profile.trees, rows.count()):
        moved = _moved(rows, tops, some, kind, drawn=True).repartition(_parts(tops, some), "tree", "node")
        place = scratch_path(data.sparkSession, "nodes")
        moved.groupBy("tree", "node").applyInArrow(finish, f"tree int, node int, {_NODE_LISTS}").write.parquet(place)
        tables.append(place)
    return WrittenTrees(features, thresholds, tops, tuple(tables))


def _moved(rows: DataFrame, tops: Sequence[Top], some: range, kind: type, drawn: bool) -> DataFrame:
    """A row for each tree that holds it (or does not), under the upper node that it leads to.

    Where that is a leaf, nothing is left to grow, and its mean is the guess.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, copies = np.ascontiguousarray(_bytes(batch["x"], kind)), _bytes(batch["copies"], np.uint8)
            number, y = batch[ROW].to_numpy(), batch["y"].to_numpy()
            for tree in some:
                node = tops[tree].descend(x)
                on = np.array(tops[tree].feature)[node] == _GOES_ON
                taken = np.flatnonzero((copies[tree] > 0) & on if drawn else copies[tree] == 0)
                at = node[taken]
                yield pa.RecordBatch.from_pydict(
                    {
                        "tree": pa.array(np.full(len(taken), tree), pa.int32()),
                        "node": pa.array(at, pa.int32()),
                        ROW: number[taken],
                        "x": _binary(x[:, taken]),
                        "y": y[taken],
                        "copies": pa.array(copies[tree][taken], pa.int32()),
                        "guess": pa.array(np.array(tops[tree].mean)[at], mask=on[taken]),
                    }
                )

    return rows.mapInArrow(run, f"tree int, node int, {ROW} bigint, x binary, y double, copies int, guess double")


def guesses_of_the_unseen(rows: DataFrame, drawn: WrittenTrees) -> DataFrame:
    """For each of the ``binned_rows`` the sum and the number of the predictions of trees without it."""
    spark, kind = rows.sparkSession, _kind(drawn.thresholds)

    def score(key: tuple, table: pa.Table, nodes: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({ROW: pa.array([], pa.int64()), "guess": pa.array([], pa.float64())})
        feature, bins, left, mean = (nodes[n][0].values.to_numpy() for n in ("feature", "bin", "left", "mean"))
        node = descend(feature, bins, left, np.ascontiguousarray(_bytes(table["x"], kind)))
        return pa.table({ROW: table[ROW], "guess": mean[node]})

    nodes = spark.read.schema(f"tree int, node int, {_NODE_LISTS}").parquet(*drawn.tables)
    place = scratch_path(spark, "guesses")
    for some in _batches_of(drawn.trees, rows.count()):
        moved, parts = _moved(rows, drawn.tops, some, kind, drawn=False), _parts(drawn.tops, some)
        led = moved.where("guess is null").repartition(parts, "tree", "node").groupBy("tree", "node")
        grown = nodes.where(F.col("tree").between(some[0], some[-1])).repartition(parts, "tree", "node")
        found = led.cogroup(grown.groupBy("tree", "node")).applyInArrow(score, f"{ROW} bigint, guess double")
        if any(f == _LEAF for t in some for f in drawn.tops[t].feature):
            found = found.unionByName(moved.where("guess is not null").select(ROW, "guess"))
        sums = found.groupBy(ROW).agg(F.sum("guess").alias("__sum"), F.count("*").cast("int").alias("oob_trees"))
        sums.write.mode("append").parquet(place)
    written = spark.read.schema(f"{ROW} bigint, __sum double, oob_trees int").parquet(place)
    return written.groupBy(ROW).agg(F.sum("__sum").alias("__sum"), F.sum("oob_trees").cast("int").alias("oob_trees"))
