"""Byte-level BPE over overlapping chunks, and decoding by joining the bytes of the ids.

A text is cut into chunks of ``CHUNK_CHARS`` code points that overlap by ``OVERLAP_CHARS``.
Rows of chunks are split into pre-tokens apart from each other. The pattern looks ahead only,
so once two chunks have a boundary at the same place, all that follows is equal: the earlier
chunk is used up to the first such place in the overlap, the later one from there on. A
chunk's last pre-token may be cut, so boundaries after its start do not count. Where an overlap
has no common boundary (one very long pre-token), the chunks are split again as one.
Then each piece is encoded by the ranks.

Null texts count as empty and have no ids; a text of one chunk needs no stitching; repeated
rows and null ids are rows like others; columns besides the id and the text are not read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliodrift.llm.batches import free_memory, text_slices

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
#: Distinct pieces whose ids a worker remembers.
CACHED_PIECES = 60_000
#: What ``\s`` stands for in the tokenizers' patterns.
WHITE_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class _Pieces(dict):
    """Ids of pieces, encoded when first asked for."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self._merges = tiktoken.Encoding(
            "ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}
        )
        self._shared = {rank: rank for rank in ranks.values()}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = tuple(map(self._shared.__getitem__, self._merges.encode_ordinary(piece)))
        if len(piece) <= 64:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = found
        return found


class Vocabulary:
    """Ranks of a rank file, the pattern that splits texts, and the bytes of the ids."""

    def __init__(self, lines: bytes, pattern: str) -> None:
        pairs = (line.split() for line in lines.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self._ranks = ranks
        by_rank = {rank: token for token, rank in ranks.items()}
        self.tokens = pa.array([by_rank.get(k, b"") for k in range(max(by_rank) + 1)], pa.binary())
        inner = pattern.replace(r"[^\s", "[^" + WHITE_SPACE)
        inner = inner.replace(r"\S", "[^" + WHITE_SPACE + "]")
        self.split = regex.compile(inner.replace(r"\s", "[" + WHITE_SPACE + "]"))

    @functools.cached_property
    def ids(self) -> _Pieces:
        """Built where texts are encoded; decoding does without it."""
        return _Pieces(self._ranks)

    def encode(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.ids.__getitem__, pieces)), np.int32)

    def decode(self, ids: pa.ListArray) -> pa.BinaryArray:
        """The joined bytes of each row's ids, which lie side by side once all are looked up."""
        flat = self.tokens.take(ids.flatten())
        offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
        rows = np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        ends = offsets[rows] if len(flat) else np.zeros(len(rows), np.int32)
        data = flat.buffers()[2] or pa.py_buffer(b"")
        return pa.BinaryArray.from_buffers(
            pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), data]
        )


@functools.lru_cache(maxsize=2)
def _vocabulary(lines: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(lines, pattern)


def bounds(split: regex.Pattern, text: str) -> np.ndarray:
    """Places where pre-tokens begin, and the end of the text."""
    pieces = split.findall(text)
    marks = np.concatenate(([0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))))
    if marks[-1] != len(text):  # the pattern skips some signs
        marks = np.array([*(m.start() for m in split.finditer(text)), len(text)])
    return marks.astype(np.int32)


def joint(left: np.ndarray, right: np.ndarray, shift: int) -> int | None:
    """The first place, counted in the left chunk, at which both chunks have a boundary.

    ``shift`` is where the right chunk begins in the left one.
    """
    places = left[:-1][np.isin(left[:-1], right[:-1] + shift)]
    return int(places[0]) if len(places) else None


def cut(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk; a last chunk never lies inside the one before it."""
    start = 0
    while True:
        end = min(len(text), start + size)
        yield start, end
        if end == len(text):
            return
        start = end - overlap


def stitched(split: regex.Pattern, chunks: Iterator[tuple[int, str, np.ndarray]]) -> Iterator[list[str]]:
    """Pieces of a text from its chunks: (start in the text, chunk, boundaries in the chunk)."""
    start, text, marks = next(chunks)
    for next_start, next_text, next_marks in chunks:
        shift = next_start - start
        place = joint(marks[marks >= shift], next_marks, shift)
        if place is None:
            # Split again from the last boundary that does not depend on the chunk's end.
            place = int(marks[-2])
            yield _between(split, text, marks[marks <= place])
            text = text[place:shift] + next_text if shift > place else next_text[place - shift :]
            start += place
            marks = bounds(split, text)
        else:
            yield _between(split, text, marks[marks <= place])
            start, text, marks = next_start, next_text, next_marks[next_marks >= place - shift]
    yield _between(split, text, marks)


def _between(split: regex.Pattern, text: str, marks: np.ndarray) -> list[str]:
    """The pieces from one mark to the next, without what the pattern skips."""
    places = marks.tolist()
    pieces = [text[a:b] for a, b in zip(places, places[1:], strict=False)]
    return [m[0] for x in pieces if (m := split.match(x))] if _skips(split) else pieces


@functools.lru_cache(maxsize=4)
def _skips(split: regex.Pattern) -> bool:
    """Whether some sign starts no pre-token; those of all kinds do in byte-level patterns."""
    return any(split.match(sign) is None for sign in ("a", "1", ".", " ", "\n", "\u00e9", "\x00"))


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` of every row; ``ranks`` is the path of a rank file.

    Texts of one chunk are encoded where they are read. The chunks of longer ones are dealt
    over the cluster, split there, and meet again by document as boundaries and text.
    """
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    lines = docs.sparkSession.sparkContext.broadcast(_read(ranks))

    def encode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(lines.value, pattern)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = [words.encode(words.split.findall(x)) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])
        free_memory()

    def cut_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = batch.column(1)[row].as_py()
                parts = list(cut(x, CHUNK_CHARS, OVERLAP_CHARS))
                name = [batch.column(2)[row].as_py()] * len(parts)
                yield pa.record_batch(
                    [
                        pa.array([batch.column(0)[row].as_py()] * len(parts), batch.column(0).type),
                        pa.array(name, pa.int64()),
                        pa.array([a for a, _ in parts], pa.int64()),
                        pa.array([x[a:b] for a, b in parts], pa.string()),
                    ],
                    ["key", "row", "start", "chunk"],
                )

    def split_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(lines.value, pattern)
        for batch in batches:
            for part in text_slices(batch, "chunk"):
                marks = [bounds(words.split, x) for x in part.column(3).to_pylist()]
                yield part.append_column("marks", pa.array(marks, pa.list_(pa.int32())))
        free_memory()

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(lines.value, pattern)
        for batch in batches:
            for row in range(batch.num_rows):
                parts = batch.column(1)[row].values
                starts = parts.field("start").to_numpy()
                chunks = (
                    (int(starts[k]), parts.field("chunk")[int(k)].as_py(), parts.field("marks")[int(k)].values.to_numpy())
                    for k in np.argsort(starts)
                )
                ids = np.concatenate([words.encode(x) for x in stitched(words.split, chunks)])
                yield pa.record_batch(
                    [batch.column(0).slice(row, 1), pa.array([ids], pa.list_(pa.int32()))], ["key", "ids"]
                )
        free_memory()

    result = f"key {kind}, ids array<int>"
    # The limit is in code points where the text is cut, so one of its length has one chunk.
    short = source.where(F.length("text") <= CHUNK_CHARS).mapInArrow(encode_short, result)
    chunk = f"key {kind}, row bigint, start bigint, chunk string"
    long = (
        source.where(F.length("text") > CHUNK_CHARS)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(cut_long, chunk)
    )
    spread = long.repartition(F.xxhash64("row", "start"))
    split = spread.mapInArrow(split_chunks, f"{chunk}, marks array<int>")
    rows = split.groupBy("row").agg(
        F.first("key").alias("key"), F.collect_list(F.struct("start", "chunk", "marks")).alias("chunks")
    )
    long_ids = rows.select("key", "chunks").mapInArrow(stitch, result)
    return short.unionByName(long_ids).withColumnRenamed("key", key)


def decode(tokens: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the joined bytes of ``ids``; null ids decode to no bytes."""
    lines = tokens.sparkSession.sparkContext.broadcast(_read(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(lines.value, pattern)
        for batch in batches:
            lists = batch.column(ids)
            sizes = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:  # a bounded number of ids at a time
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 500_000, "right")))
                part = batch.slice(at, end - at)
                yield part.append_column("decoded", words.decode(part.column(ids)))
                at = end
        free_memory()

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())]))


def token_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Number of ids, digest of the ids and digest of the decoded bytes of every document."""
    out = decode(encode(docs, ranks, pattern), ranks, pattern)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _read(path: str) -> bytes:
    """The rank file: tens of thousands of lines, read by the driver and broadcast."""
    with open(path, "rb") as file:
        return file.read()
