"""Importance resampling of documents towards a target text, by gains of hashed n-grams.

Texts are lower-cased (A-Z) and cut into words (digits, a-z and bytes of other scripts); runs of
1 to ``sizes`` words, joined by a space, are features. A batch of texts is interned at once in
an open-addressed table of NumPy arrays: the XXH64 of a feature's bytes is its key, places are
probed in turn, and a place counts as the feature's only if the bytes agree too. So the bucket
(a CRC-32 of the bytes) is worked out once for each distinct feature of a batch; the counts of
the table add up to the corpus counts, and the places of the occurrences gather the gains.

Every document and every target text is counted, whole: long texts are cut between words, the
last words of a piece going ahead of the next one. A task keeps one counter per bucket; the
buckets' sums are all that reaches the driver, their gains all that is broadcast. The draw
adds Gumbel noise to the weights and keeps the highest, numbered over a range-sorted table, so
neither the ranking nor the drawn documents pass through one task.

Null and empty texts have no features and weight 0. Repeated rows are rows of their own, and a
null id is hashed like an empty one and goes first among ties. Empty tables give no rows, an
empty target leaves T = 0. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliodrift.llm.batches import free_memory, text_slices
from heliodrift.llm.checksum_sql import crc32_sql
from heliodrift.llm.tables import stored
from heliodrift.operators.sequences import row_numbers

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
#: Bytes of text that are interned at a time.
STEP_BYTES = 500_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BREAK = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# The multipliers of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class Ranges:
    """Byte ranges of one buffer, hashed and compared eight bytes at a time."""

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        self.data, self.starts, self.ends = data, starts, ends
        self.sizes = ends - starts
        self._padded = data + bytes(8)
        # The eight bytes from each place on, as one number.
        self._lanes = np.ndarray((len(data) + 1,), "<u8", self._padded, strides=(1,))

    def _bytes_at(self, places: np.ndarray, count: np.ndarray | int) -> np.ndarray:
        """Up to eight bytes from each place; a ``count`` under 8 leaves the rest out."""
        lanes = self._lanes[places].astype(np.uint64)
        spare = (np.uint64(8) - np.asarray(count, np.uint64)) * np.uint64(8)
        return (lanes << spare) >> spare

    def hashes(self) -> np.ndarray:
        """XXH64 of each range; those of 32 bytes and more by the library."""
        out = _P5 + self.sizes.astype(np.uint64)
        at = self.starts.copy()
        short = self.sizes < 32
        for _ in range(3):
            now = np.flatnonzero(short & (self.ends - at >= 8))
            lane = _turn(self._bytes_at(at[now], 8) * _P2, 31) * _P1
            out[now] = _turn(out[now] ^ lane, 27) * _P1 + _P4
            at[now] += 8
        now = np.flatnonzero(short & (self.ends - at >= 4))
        out[now] = _turn(out[now] ^ (self._bytes_at(at[now], 4) * _P1), 23) * _P2 + _P3
        at[now] += 4
        for _ in range(3):
            now = np.flatnonzero(short & (self.ends > at))
            out[now] = _turn(out[now] ^ (self._bytes_at(at[now], 1) * _P5), 11) * _P1
            at[now] += 1
        out = (out ^ (out >> np.uint64(33))) * _P2
        out = (out ^ (out >> np.uint64(29))) * _P3
        out ^= out >> np.uint64(32)
        for k in np.flatnonzero(~short):
            out[k] = xxhash.xxh64_intdigest(self[k])
        return out

    def __getitem__(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]]

    def equal(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the ranges of two lists of numbers hold the same bytes, pair by pair."""
        same = self.sizes[left] == self.sizes[right]
        long = same & (self.sizes[left] > 256) & (left != right)
        for k in np.flatnonzero(long):
            same[k] = self[left[k]] == self[right[k]]
        open_ = np.flatnonzero(same & ~long & (left != right))
        done = 0
        while len(open_):
            rest = np.minimum(self.sizes[left[open_]] - done, 8)
            a = self._bytes_at(self.starts[left[open_]] + done, rest)
            b = self._bytes_at(self.starts[right[open_]] + done, rest)
            same[open_[a != b]] = False
            done += 8
            open_ = open_[(a == b) & (self.sizes[left[open_]] > done)]
        return same


class Interned(NamedTuple):
    """An open-addressed table: a place without a feature has ``first`` -1 and count 0."""

    keys: np.ndarray
    first: np.ndarray  # the occurrence whose bytes the place stands for
    buckets: np.ndarray
    counts: np.ndarray
    places: np.ndarray  # of each occurrence


def intern(ranges: Ranges, buckets: int = BUCKETS, hashes: np.ndarray | None = None) -> Interned:
    """Give each occurrence the place of its feature; the table is at most half full."""
    hashes = ranges.hashes() if hashes is None else hashes
    size = 1 << max(4, (2 * len(hashes)).bit_length())
    mask = np.uint64(size - 1)
    keys, first = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
    at = (hashes & mask).astype(np.int64)
    places, waiting = np.empty(len(hashes), np.int64), np.arange(len(hashes))
    while len(waiting):
        here = at[waiting]
        free = first[here] < 0
        # Of several occurrences that want a free place the first one has it.
        first[here[free][::-1]] = waiting[free][::-1]
        holder = first[here]
        keys[here] = hashes[holder]
        found = keys[here] == hashes[waiting]
        found[found] = ranges.equal(holder[found], waiting[found])
        places[waiting[found]] = here[found]
        waiting = waiting[~found]
        at[waiting] = (at[waiting] + 1) & int(mask)
    used = np.flatnonzero(first >= 0)
    of_place = np.zeros(size, np.int32)
    of_place[used] = [zlib.crc32(ranges[k]) % buckets for k in first[used].tolist()]
    return Interned(keys, first, of_place, np.bincount(places, minlength=size), places)


def _pieces(texts: Sequence[bytes], sizes: int) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Groups of texts of bounded bytes, their rows, and how many first words were counted before."""
    group: list[bytes] = []
    rows: list[int] = []
    total = 0
    for row, text in enumerate(texts):
        if total and total + len(text) > STEP_BYTES:
            yield group, rows, [0] * len(rows)
            group, rows, total = [], [], 0
        if len(text) <= STEP_BYTES:
            group.append(text)
            rows.append(row)
            total += len(text) + 1
            continue
        at, carried = 0, []
        while at < len(text):
            space = _BREAK.search(text, at + STEP_BYTES)
            end = space.end() if space else len(text)
            piece = b" ".join([*carried, text[at:end]])
            yield [piece], [row], [len(carried)]
            carried = _WORD.findall(piece)[1 - sizes :] if sizes > 1 else []
            at = end
    if group:
        yield group, rows, [0] * len(rows)


class Features(NamedTuple):
    ranges: Ranges
    rows: np.ndarray  # the row of each feature
    words: np.ndarray  # words of each row


def features(texts: Sequence[bytes], sizes: int = 1) -> Iterator[Features]:
    """All runs of 1 to ``sizes`` words of all texts, some texts at a time."""
    for group, owners, carried in _pieces([x.translate(_LOWER) for x in texts], sizes):
        data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
        inside = _IN_WORD[data]
        # One space between the words of the buffer, so that a run of words is one range.
        kept = inside | np.concatenate(([False], inside[:-1]))
        clean = np.where(inside, data, 0x20).astype(np.uint8)[kept]
        marks = np.flatnonzero(clean == 0x20)
        starts = np.concatenate(([0], marks[:-1] + 1)) if len(marks) else marks
        word_at = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        edges = np.cumsum([len(x) + 1 for x in group])
        piece = np.searchsorted(edges, word_at, "right")
        counted = np.arange(len(marks)) - np.searchsorted(piece, piece) >= np.asarray(carried, np.int64)[piece]
        found = [(starts[:0], starts[:0], piece[:0])]
        for size in range(1, sizes + 1):
            last = np.arange(size - 1, len(marks))
            last = last[(piece[last] == piece[last - size + 1]) & counted[last]]
            found.append((starts[last - size + 1], marks[last], piece[last]))
        begin, end, owner = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = np.asarray(owners, np.int64)
        words = np.bincount(rows[piece[counted]], minlength=len(texts))
        yield Features(Ranges(clean.tobytes(), begin, end), rows[owner], words)


def bucket_counts(texts: DataFrame, text: str = "text", sizes: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``: the occurrences of features in all texts; buckets without any are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                for found in features([x.encode() for x in part.column(0).to_pylist()], sizes):
                    table = intern(found.ranges, buckets)
                    np.add.at(total, table.buckets, table.counts)
        free_memory()
        yield pa.record_batch([pa.array([total], pa.list_(pa.int64()))], ["counts"])

    source = texts.select(F.coalesce(texts[text], F.lit("")).alias("text"))
    partial = source.mapInArrow(run, "counts array<bigint>").select(F.posexplode("counts").alias("bucket", "n"))
    return partial.where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, target to source, of each bucket."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, out in ((source, s), (target, t)):
        for row in counts.collect():  # one row a bucket at most
            out[row["bucket"]] = row["n"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(
    docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", sizes: int = 1
) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``weight``, the sum of gains, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sums = np.zeros((3, part.num_rows), np.int64)
                for found in features([x.encode() for x in part.column(1).to_pylist()], sizes):
                    table = intern(found.ranges, len(shared.value))
                    sums[0] += found.words
                    sums[1] += np.bincount(found.rows, minlength=part.num_rows)
                    np.add.at(sums[2], found.rows, shared.value[table.buckets[table.places]])
                yield pa.record_batch([part.column(0), *map(pa.array, sums)], ["key", "n_words", "n_features", "weight"])
        free_memory()

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    found = source.mapInArrow(run, f"key {kind}, n_words bigint, n_features bigint, weight bigint")
    return found.withColumnRenamed("key", key)


def noise(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate, drawn by a digest of the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((number + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    sizes: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Weight, score and rank of every row of ``docs``; rows that are not drawn have no rank.

    Of the rows with ``min_words`` words ``percent`` in a hundred are drawn, rounded down: those
    of the highest scores, ties to the smaller id.
    """
    gain = gains(bucket_counts(docs, text, sizes, buckets), bucket_counts(target, target_text, sizes, buckets), buckets)
    scored = weights(docs, gain, key, text, sizes).withColumnRenamed(key, "key")
    table = stored(scored.withColumn("score", F.col("weight") + noise(F.col("key"), seed)))
    fit = F.col("n_words") >= min_words
    wanted = percent * table.where(fit).count() // 100
    # The lowest negative score comes first.
    ordered = table.where(fit).withColumn("fall", -F.col("score"))
    ranked = row_numbers(ordered, "rank", by=(), order=("fall", "key")).drop("fall")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = table.where(~fit).withColumn("rank", F.lit(None).cast("bigint"))
    columns = ["key", "n_features", "weight", "score", "rank", "n_words"]
    return ranked.select(*columns).unionByName(rest.select(*columns)).withColumnRenamed("key", key)


_UPPER = "".join(map(chr, range(65, 91)))


def _words_sql(table: str, columns: str) -> str:
    return f"""SELECT {columns} unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM {table}"""


SQL = f"""
WITH docs AS (SELECT *, row_number() OVER () AS place FROM documents),
said AS ({_words_sql('docs', 'place,')}),
asked AS ({_words_sql('benchmark', '')}),
named AS (SELECT word, {crc32_sql('word')} % {BUCKETS} AS bucket
          FROM (SELECT word FROM said UNION SELECT word FROM asked)),
s AS (SELECT bucket, count(*) AS n FROM said JOIN named USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM asked JOIN named USING (word) GROUP BY bucket),
sizes AS (SELECT (SELECT count(*) FROM said)::DOUBLE + {BUCKETS} AS all_s, (SELECT count(*) FROM asked)::DOUBLE + {BUCKETS} AS all_t),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * all_s / ((s.n + 1)::DOUBLE * all_t)))::BIGINT AS gain
          FROM s LEFT JOIN t USING (bucket) CROSS JOIN sizes),
weighed AS (SELECT place, count(*) AS n, sum(gain)::BIGINT AS weight
            FROM said JOIN named USING (word) JOIN gains USING (bucket) GROUP BY place),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (place)),
fit AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * (SELECT count(*) FROM fit) // 100 THEN r END AS rank FROM fit
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < {MIN_WORDS}
"""
