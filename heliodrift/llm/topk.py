"""Exact top-k by inner product over an impact-ordered index, read a score at a time.

Components become integers, ``floor(1024 * x)``. Vectors are dealt to shards of about
``SHARD_ROWS`` by a hash of their id. In a shard the postings of each dimension are cut by
value into segments of one quantised impact, the most a member can add to a score; they also
hold the exact values.

A query visits the segments of a shard by descending quantised impact and adds it to each
member's sum. What a vector may still gain is the number of its dimensions not met times the
impact of the next segment. From time to time the best sums are scored exactly, which gives the
k-th best score so far; once few vectors can reach it, all of those are scored exactly and the
others are proven out. So the result does not depend on where the visit stops.

The index is dealt out once, a shard to a task, which holds that shard and reads the queries behind
it as a stream, ``QUERY_ROWS`` at a time; a query's best rows of each shard meet at the end. Vectors that are null or hold nulls or
non-finite components take no part, nor do null ids; rows of one id count once, by their
largest vector; vectors of different lengths don't meet; equal scores go to the smaller id;
scaled components are clipped at 2**62 and scores to 64 bits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
SHARD_ROWS = 4_096
QUERY_ROWS = 512
LEVELS = 16
TOP = 10
#: Segments between two looks at what is proven.
STRIDE = 128
_LIMIT = float(2**62)


def usable(vector: str) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    kept = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    kept = kept.where(F.col("id").isNotNull() & usable("vector"))
    return kept.groupBy("id").agg(F.max("vector").alias("vector"))


def _scaled(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = np.concatenate([np.zeros(0), *(x.flatten().to_numpy() for x in column.chunks)])
    return np.clip(np.floor(SCALE * flat), -_LIMIT, _LIMIT).astype(np.int64).reshape(len(column), size)


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows of postings: one for each shard, dimension and segment, and one with a shard's ids."""
    vectors = _vectors(df, key, vector).withColumn("size", F.size("vector"))
    shards = 1 + vectors.count() // SHARD_ROWS
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        size, shard = group["size"][0].as_py(), group["shard"][0].as_py()
        values = _scaled(group["vector"], size)
        rows = [(-1, 0, 0, group["id"].to_pylist(), [])]
        for d in range(size):
            order = np.argsort(values[:, d], kind="stable")
            column = values[order, d]
            low, high = int(column[0]), int(column[-1])
            width = max(1, -(-(high - low + 1) // LEVELS))
            cuts = np.searchsorted(column, [low + k * width for k in range(1, LEVELS)])
            for part, held in zip(np.split(order, cuts), np.split(column, cuts), strict=True):
                if len(part):
                    rows.append((d, int(held[0]), int(held[-1]), part, held))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        fixed = [pa.array([x] * len(rows), kind) for x, kind in ((size, pa.int32()), (shard, pa.int64()))]
        return pa.table([*fixed, *columns], _INDEX_NAMES)

    return dealt.groupBy("size", "shard").applyInArrow(build, _INDEX)


_INDEX = "size int, shard bigint, dim int, low bigint, high bigint, members array<bigint>, held array<bigint>"
_INDEX_NAMES = ["size", "shard", "dim", "low", "high", "members", "held"]


class Shard:
    """A shard's segments and, read off their postings, its vectors."""

    def __init__(self, rows: pa.Table) -> None:
        size = rows["size"][0].as_py()
        members = [x.values.to_numpy() for x in rows["members"]]
        held = [x.values.to_numpy() for x in rows["held"]]
        dims = rows["dim"].to_numpy()
        (own,) = np.flatnonzero(dims == -1)
        self.ids = members[own]
        self.values = np.zeros((len(self.ids), size), np.int64)
        keep = np.flatnonzero(dims >= 0)
        for k in keep:
            self.values[members[k], dims[k]] = held[k]
        self.members = [members[k] for k in keep]
        self.dims = dims[keep]
        self.low, self.high = (rows[c].to_numpy()[keep] for c in ("low", "high"))
        self.largest = int(np.abs(self.values).max(initial=0))

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the ``k`` best vectors but the query's own."""
        mine = np.flatnonzero(self.ids == query_id)
        if self.largest * int(np.abs(query).max(initial=0)) * max(1, len(query)) >= 2**52:
            return self._all_exact(mine, query, k)
        impact = np.maximum(query[self.dims] * self.low, query[self.dims] * self.high).astype(float)
        order = np.argsort(-impact, kind="stable")
        sums, met = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        scores = np.full(len(self.ids), -np.inf)
        scored = np.zeros(len(self.ids), bool)
        sums[mine], scored[mine] = -np.inf, True
        done = 0
        while True:
            ahead = impact[order[done]] if done < len(order) else 0.0
            bound = sums + (len(query) - met) * ahead
            bound[scored] = -np.inf
            best = np.argpartition(-bound, min(2 * k, len(bound) - 1))[: 2 * k]
            self._score(best[~scored[best]], query, scores, scored)
            floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
            # What is exactly the k-th score may still win its tie.
            possible = np.flatnonzero(~scored & (bound >= floor))
            if len(possible) <= max(4 * k, len(self.ids) // 32) or done == len(order):
                self._score(possible, query, scores, scored)
                break
            visited = order[done : done + STRIDE]
            who = np.concatenate([self.members[x] for x in visited])
            gains = np.repeat(impact[visited], [len(self.members[x]) for x in visited])
            sums += np.bincount(who, gains, len(sums))
            met += np.bincount(who, minlength=len(sums))
            done = min(done + STRIDE, len(order))
        found = np.flatnonzero(np.isfinite(scores))
        found = found[np.lexsort((self.ids[found], -scores[found]))][:k]
        return [(int(scores[x]), int(self.ids[x])) for x in found]

    def _score(self, which: np.ndarray, query: np.ndarray, scores: np.ndarray, scored: np.ndarray) -> None:
        scores[which] = self.values[which] @ query
        scored[which] = True

    def _all_exact(self, mine: np.ndarray, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """For numbers whose sums may not fit a float's digits."""
        others = np.delete(np.arange(len(self.ids)), mine)
        products = self.values[others].astype(object) @ query.astype(object)
        limit = 2**63
        rows = [(max(-limit, min(limit - 1, int(s))), int(i)) for s, i in zip(products, self.ids[others], strict=True)]
        return sorted(rows, key=lambda r: (-r[0], r[1]))[:k]


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut where the shard, or what its rows are, changes."""
    if not batch.num_rows:
        return
    keys = [batch["size"].to_numpy(), batch["shard"].to_numpy(), batch["asked"].to_numpy(zero_copy_only=False)]
    cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def search(index: DataFrame, queries: DataFrame, k: int = TOP, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` best rows for each query."""
    wanted = _vectors(queries, key, vector).withColumn("size", F.size("vector"))
    last = index.agg(F.max("shard")).first()[0]
    every = F.sequence(F.lit(0), F.lit(-1 if last is None else last).cast("bigint"))
    shards = F.explode(every if last is not None else F.array().cast("array<bigint>")).alias("shard")
    asked = wanted.select("size", shards, F.lit(True).alias("asked"), "id", "vector")
    both = index.withColumn("asked", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    # A shard's postings and then, in the same task, the queries.
    dealt = both.repartition("size", "shard").sortWithinPartitions("size", "shard", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings: list[pa.RecordBatch] = []
        here, shard = None, None
        for batch in batches:
            for part in _runs(batch):
                place = (part["size"][0].as_py(), part["shard"][0].as_py())
                if place != here:
                    here, shard, postings = place, None, []
                if not part["asked"][0].as_py():
                    postings.append(part)
                    continue
                if postings:
                    shard, postings = Shard(pa.Table.from_batches(postings)), []
                for at in range(0, part.num_rows if shard else 0, QUERY_ROWS):
                    some = part.slice(at, QUERY_ROWS)
                    vectors = _scaled(pa.chunked_array([some["vector"]]), shard.values.shape[1])
                    found: list[tuple[int, int, int]] = []
                    for query_id, query in zip(some["id"].to_pylist(), vectors, strict=True):
                        found += [(query_id, i, s) for s, i in shard.top(query_id, query, k)]
                    columns = list(zip(*found, strict=True)) or [()] * 3
                    yield pa.record_batch(
                        [pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"]
                    )

    rows = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL over ``embeddings`` for the search of ids divisible by 100.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
WHERE rank <= 10
"""
