"""Benchmark passages in documents: SimHash of item-sized windows, then exact similarity.

An item is the bag of its five-word shingles (A-Z folded); a shingle weighs as much as it
occurs. Every window of a document with as many words as the item is compared with it; a
document that is shorter than the item is one window.

A window that is similar enough lacks at most a quarter of the item's shingles. So of any more of
them it holds one: an item is anchored by its ``1 + size // 4`` shingles that fewest items
have, and it is compared with the windows that hold one of these, and with no others. Windows
and items that share nothing rare never meet, however many items are of one size.

A fingerprint has ``BITS`` bits, the signs of the weighted sums of the shingles' bits. Two
fingerprints within ``RADIUS`` bits differ by ``RADIUS // BLOCKS`` bits at most in one of
``BLOCKS`` blocks, so none of them is lost when pairs are first compared block by block. At a
similarity of 0.75 the mean distance is 22 bits and its deviation 4.3. Candidates are confirmed by the exact weighted
similarity: the sum of the smaller weights over that of the larger ones.

Items are dealt to blocks of about ``BLOCK_BYTES`` of text, and the documents are scanned once
for each, so what is broadcast is bounded. An item of one to four words is one shingle of that
length, found by its hash alone; items and documents without words match nothing; null texts
count as empty; null ids are returned as they are; repeated rows give repeated results; of equal
similarities the first window is reported; columns besides ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodrift.llm.batches import free_memory, map_text, text_slices
from heliodrift.llm.words import SHINGLE_WORDS, mix, row_shingles, word_hashes

BITS = 128
RADIUS = 40
BLOCKS = 8
PERCENT = 75
BLOCK_BYTES = 8_000_000
_WINDOWS = 4_096
_COUNTS = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)


def _votes(shingles: np.ndarray) -> np.ndarray:
    """One row of ``BITS`` votes of +1 or -1 for each shingle."""
    halves = np.stack([mix(shingles, 11), mix(shingles, 12)], axis=1)
    bits = np.unpackbits(halves.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _blocks(sums: np.ndarray) -> np.ndarray:
    """The fingerprints of rows of summed votes, as ``BLOCKS`` numbers of 16 bits each."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def window_prints(shingles: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all runs of ``size`` shingles."""
    sums = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(_votes(shingles), axis=0, out=sums[1:])
    return _blocks(sums[size:] - sums[:-size])


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller weights of two bags over the sum of the larger ones."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(a) + len(b) - common)


class Items:
    """Benchmark items, indexed by their shingles and by the blocks of their fingerprints."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        self.ids, self.texts = ids, [x.encode() for x in texts]

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "texts": self.texts}

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        return word_hashes(self.texts)

    @cached_property
    def bags(self) -> list[np.ndarray]:
        return list(row_shingles(*self._words))

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.diff(self._words[1])

    @cached_property
    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The rarest shingles of items of five words and more, sorted, and the items that have them."""
        long = [k for k, n in enumerate(self.lengths) if n >= SHINGLE_WORDS]
        if not long:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known, items_with = np.unique(np.concatenate([np.unique(self.bags[k]) for k in long]), return_counts=True)
        parts = []
        for k in long:
            bag = self.bags[k]
            rarity = items_with[np.searchsorted(known, bag)]
            # Copies of a shingle count one by one, as they do in the similarity.
            first = np.lexsort((bag, rarity))[: len(bag) * (100 - PERCENT) // 100 + 1]
            parts.append(np.unique(bag[first]))
        owner = np.repeat(long, [len(x) for x in parts])
        order = np.argsort(np.concatenate(parts), kind="stable")
        return np.concatenate(parts)[order], owner[order]

    @cached_property
    def prints(self) -> np.ndarray:
        """The blocks of the fingerprint of each item."""
        sums = [_votes(bag).sum(axis=0) if len(bag) else np.zeros(BITS, np.int32) for bag in self.bags]
        return _blocks(np.array(sums, np.int32).reshape(-1, BITS))

    @cached_property
    def short(self) -> dict[int, dict[int, list[int]]]:
        """Items of fewer than five words, by their length and hash."""
        found: dict[int, dict[int, list[int]]] = {}
        for k, n in enumerate(self.lengths):
            if 0 < n < SHINGLE_WORDS:
                found.setdefault(int(n), {}).setdefault(int(self.bags[k][0]), []).append(k)
        return found

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, float, int]]:
        """(row, item, first word, similarity, differing bits) of the best window of each pair."""
        words, at = word_hashes(texts)
        rows = list(row_shingles(words, at))
        keys, owner = self.anchors
        sizes = np.array([len(x) for x in rows], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.concatenate(rows) if rows else words
        low, high = np.searchsorted(keys, flat), np.searchsorted(keys, flat, "right")
        hits = np.flatnonzero(high > low)
        # Every place of a text with every item that it anchors.
        counts = (high - low)[hits]
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        items = owner[np.repeat(low[hits], counts) + within]
        places = np.repeat(hits, counts)
        where = np.searchsorted(starts, places, "right") - 1
        lengths = np.array([len(bag) for bag in self.bags], np.int64)
        order = np.lexsort((places, items, lengths[items], where))
        edges = np.flatnonzero(np.diff(where[order])) + 1
        for mine in np.split(order, edges) if len(order) else []:
            row = int(where[mine[0]])
            same_size = np.flatnonzero(np.diff(lengths[items[mine]])) + 1
            for part in np.split(mine, same_size):
                yield from self._near(row, rows[row], items[part], places[part] - starts[row])
        for length, wanted in sorted(self.short.items()):
            yield from _short_matches(words, at, length, wanted)

    def _near(self, row: int, shingles: np.ndarray, items: np.ndarray, places: np.ndarray):
        """Matches of the items of one size, each anchored at some places of a text."""
        size = len(self.bags[items[0]])
        each = np.split(np.arange(len(items)), np.flatnonzero(np.diff(items)) + 1)
        spans = {int(items[k[0]]): _stretches(places[k], size, len(shingles)) for k in each}
        best: dict[int, tuple[float, int, int]] = {}
        # Windows that several items ask for are fingerprinted once, some thousands at a time.
        for first, last in _pieces(_stretches(np.unique(places), size, len(shingles))):
            part = shingles[first : last + size]
            found = window_prints(part, min(size, len(part)))
            for item, ranges in spans.items():
                for a, b in ranges:
                    a, b = max(a, first), min(b, last)
                    if a <= b:
                        self._compare(item, found[a - first : b + 1 - first], shingles, a, size, best)
        for item, (value, place, bits) in sorted(best.items()):
            yield row, item, -place, value, -bits

    def _compare(self, item: int, found: np.ndarray, shingles: np.ndarray, start: int, size: int, best: dict) -> None:
        differing = _COUNTS[found ^ self.prints[item]]
        candidates = (differing <= RADIUS // BLOCKS).any(axis=1)
        distance = differing.sum(axis=1, dtype=np.int64)
        for window in np.flatnonzero(candidates & (distance <= RADIUS)):
            place = int(start + window)
            value = weighted_similarity(shingles[place : place + size], self.bags[item])
            rank = (value, -place, -int(distance[window]))
            if 100 * value >= PERCENT and rank > best.get(item, (0.0, 0, 0)):
                best[item] = rank


def _stretches(places: np.ndarray, size: int, count: int) -> list[tuple[int, int]]:
    """First and last start of the runs of windows that hold one of the sorted places."""
    last_start = max(0, count - size)
    lows, highs = np.clip(places - size + 1, 0, last_start), np.minimum(places, last_start)
    # A run ends where the next place's first window does not follow the windows so far.
    ends = np.flatnonzero(lows[1:] > np.maximum.accumulate(highs)[:-1] + 1)
    firsts = lows[np.concatenate(([0], ends + 1))]
    lasts = np.maximum.accumulate(highs)[np.concatenate((ends, [len(places) - 1]))]
    return list(zip(firsts.tolist(), lasts.tolist(), strict=True))


def _pieces(stretches: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for first, last in stretches:
        for start in range(first, last + 1, _WINDOWS):
            yield start, min(last, start + _WINDOWS - 1)


def _short_matches(words: np.ndarray, at: np.ndarray, length: int, wanted: dict[int, list[int]]):
    keys = np.array(sorted(wanted), np.uint64)
    for row, found in enumerate(row_shingles(words, at, length)):
        if at[row + 1] - at[row] >= length:
            for key in keys[np.isin(keys, found)]:
                place = int(np.flatnonzero(found == key)[0])
                for item in wanted[int(key)]:
                    yield row, item, place, 1.0, 0


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> list[Broadcast]:
    """The items as broadcast parts of bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item).alias("item"), F.coalesce(text, F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = 1 + total // BLOCK_BYTES
    block = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    parts = []
    for k in range(count):
        rows = items.where(block == k).orderBy("item", "text").collect()
        if rows:
            parts.append(spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows])))
    return parts


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item it holds: where, how similar, how many bits apart."""
    kind = docs.schema[key].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"key {kind}, item_id {item_kind}, first_word bigint, similarity double, differing_bits int"
    source = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for part in item_blocks(benchmark):

        def run(batch: pa.RecordBatch, part=part) -> pa.RecordBatch:
            items = part.value
            found = list(items.matches([x.encode() for x in batch.column(1).to_pylist()]))
            keys, rest = batch.column(0), list(zip(*found, strict=True)) or [()] * 5
            return pa.record_batch(
                [
                    keys.take(pa.array(rest[0], pa.int64())),
                    pa.array([items.ids[k] for k in rest[1]], pa.int64() if item_kind == "bigint" else None),
                    pa.array(rest[2], pa.int64()),
                    pa.array(rest[3], pa.float64()),
                    pa.array(rest[4], pa.int32()),
                ],
                ["key", "item_id", "first_word", "similarity", "differing_bits"],
            )

        out = out.unionByName(map_text(source, "text", run, schema))
    return out.withColumnRenamed("key", key)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item; nothing is shuffled."""
    for part in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in text_slices(batch, text):
                    texts = [(x or "").encode() for x in piece.column(text).to_pylist()]
                    dirty = {match[0] for match in part.value.matches(texts)}
                    yield piece.filter(pa.array([k not in dirty for k in range(len(texts))], pa.bool_()))
            free_memory()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


#: DuckDB SQL for the result of ``contaminated`` without ``differing_bits``; items of five words and more.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
ds AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '')
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s FROM d),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark),
bs AS (SELECT item_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s
  FROM b WHERE len(w) >= 5),
bag AS (SELECT item_id, item, count(*) AS c FROM (SELECT item_id, unnest(s) AS item FROM bs) GROUP BY ALL),
pairs AS (
  SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest(s) AS item FROM ds) JOIN bag USING (item)),
wins AS (
  SELECT doc_id, item_id, len(bs.s) AS m, unnest(range(0, greatest(len(ds.s) - len(bs.s), 0) + 1)) AS first_word, ds.s
  FROM pairs JOIN ds USING (doc_id) JOIN bs USING (item_id)),
parts AS (SELECT doc_id, item_id, m, first_word, s[first_word + 1:first_word + m] AS p FROM wins),
bags AS (
  SELECT doc_id, item_id, m, first_word, size, item, count(*) AS c
  FROM (SELECT doc_id, item_id, m, first_word, len(p) AS size, unnest(p) AS item FROM parts) GROUP BY ALL),
shared AS (
  SELECT doc_id, item_id, first_word, any_value(m + size) AS total, sum(least(bags.c, bag.c))::BIGINT AS both_have
  FROM bags JOIN bag USING (item_id, item) GROUP BY ALL),
found AS (
  SELECT doc_id, item_id, first_word, both_have::DOUBLE / (total - both_have) AS similarity
  FROM shared WHERE 100 * both_have >= 75 * (total - both_have))
SELECT doc_id, item_id, first_word::BIGINT AS first_word, similarity FROM found
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first_word) = 1
"""
