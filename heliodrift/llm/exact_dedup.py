"""Exact duplicates by deterministic naming of blocks.

White space (space, tab to carriage return) is deleted from a text, the rest is cut into blocks
of ``BLOCK_BYTES``. All distinct blocks are sorted and numbered: equal blocks have one integer
name. Then adjacent names are paired and the distinct pairs sorted and numbered in the same
way, and so on, until each document has one name. Two documents are equal if and only if they
reach the same name in the same round: names stand for bytes that were compared, not hashed.

Blocks are sorted within ``BUCKETS`` ranges of a digest, and a name is the bucket plus the rank
inside it times their number, so it follows from the blocks alone. A document's blocks find their
names by digest; before that it is proved that no two different blocks share one (they would
lie side by side in the sort), else all is done again with the next seed. Copies of a block fall
together in the tasks that read it, so one text that many rows hold is sent once by each task,
and rows with many blocks leave as many short rows of (row, place, name).

Null counts as empty; all texts without anything but white space are equal. Of equal texts the
row with the most code points stays, then that of the smallest id (null last), then any one of
the rows that agree in both. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliodrift.llm.batches import free_memory, text_slices
from heliodrift.llm.tables import stored

#: What does not count in a text.
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
BLOCK_BYTES = 4_096
BUCKETS = 65_536
#: Blocks that a task remembers, so as not to send them again.
REMEMBERED = 4_096

Digest = Callable[[bytes, int], bytes]


def block_digest(block: bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(block, seed=seed)


def normalised(text: str) -> bytes:
    return text.encode().translate(None, WHITE_SPACE)


def blocks(data: bytes) -> list[bytes]:
    """Blocks of equal size, the last one shorter; no bytes are one empty block."""
    return [data[at : at + BLOCK_BYTES] for at in range(0, max(1, len(data)), BLOCK_BYTES)]


def _numbered(distinct: DataFrame, bucket: Column, order: list[str], extra: dict[str, Column]) -> DataFrame:
    """Distinct rows with ``name``, their rank inside the bucket; one exchange, by bucket."""
    spread = distinct.withColumn("bucket", F.pmod(bucket, F.lit(BUCKETS)).cast("long")).repartition("bucket")
    sorted_ = Window.partitionBy("bucket").orderBy(*order)
    rank = F.row_number().over(sorted_).cast("long")
    return spread.distinct().withColumns({"name": rank * BUCKETS + F.col("bucket"), **extra}).drop("bucket")


def block_names(docs: DataFrame, seed: int = 0, digest: Digest = block_digest) -> DataFrame:
    """``digest`` and ``name`` of every distinct block; ``clash`` marks digests of several blocks.

    ``docs`` has the column ``text`` alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                new = []
                for text in part.column(0).to_pylist():
                    for block in blocks(normalised(text)):
                        mark = digest(block, seed)
                        if seen.get(mark) != block:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen[mark] = block
                            new.append((mark, block))
                if new:
                    yield pa.record_batch([pa.array(x, pa.binary()) for x in zip(*new, strict=True)], ["digest", "block"])
        free_memory()

    sorted_ = Window.partitionBy("bucket").orderBy("digest", "block")
    clash = (F.lag("digest").over(sorted_) == F.col("digest")) | (F.lead("digest").over(sorted_) == F.col("digest"))
    found = docs.mapInArrow(run, "digest binary, block binary")
    named = _numbered(found, F.xxhash64("digest"), ["digest", "block"], {"clash": F.coalesce(clash, F.lit(False))})
    return named.drop("block")


def _described(docs: DataFrame, kind: str, seed: int, digest: Digest) -> DataFrame:
    """``row``, ``key``, ``n_chars``, digest of the normalised text and digests of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column(1).to_pylist()
                plain = [normalised(x) for x in texts]
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array(map(len, texts), pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in plain]),
                        pa.array([[digest(b, seed) for b in blocks(x)] for x in plain], pa.list_(pa.binary())),
                    ],
                    ["key", "n_chars", "text_sha256", "digests"],
                )
        free_memory()

    schema = f"key {kind}, n_chars bigint, text_sha256 string, digests array<binary>"
    # Written with the row numbers, so a number is the same wherever it is read.
    return stored(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def identities(described: DataFrame, names: DataFrame) -> DataFrame:
    """``row``, ``round`` and ``name``: equal for equal sequences of blocks, and only for them."""
    cells = described.select("row", F.size("digests").alias("n"), F.posexplode("digests").alias("place", "digest"))
    cells = stored(cells.join(names, "digest").select("row", "n", "place", "name"))
    left = described.agg(F.max(F.size("digests"))).first()[0] or 0
    done = [cells.where("n = 1").select("row", F.lit(0).alias("round"), "name")]
    while left > 1:
        pair = (
            cells.where("n > 1")
            .groupBy("row", F.shiftright("place", 1).alias("place"))
            .agg(
                F.first("n").alias("n"),
                F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("a"),
                # A last name without a neighbour is paired with what no name is.
                F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        pairs = stored(pair)
        distinct = pairs.select("a", "b").distinct()
        names = _numbered(distinct, F.xxhash64("a", "b"), ["a", "b"], {})
        cells = stored(
            pairs.join(names, ["a", "b"]).select("row", ((F.col("n") + 1) / 2).cast("int").alias("n"), "place", "name")
        )
        left = (left + 1) // 2
        done.append(cells.where("n = 1").select("row", F.lit(len(done)).alias("round"), "name"))
    out = done[0]
    for table in done[1:]:
        out = out.unionByName(table)
    return out


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Digest = block_digest) -> DataFrame:
    """One row for each row of ``docs``: the id that stays for its text, and the group's size.

    ``kept`` marks the row that stays; ``text_sha256`` is the digest of the normalised text.
    """
    source = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    for seed in count():
        names = stored(block_names(source.select("text"), seed, digest))
        if names.where("clash").isEmpty():
            break
    described = _described(source, kind, seed, digest)
    rows = stored(described.drop("digests").join(identities(described, names.select("digest", "name")), "row"))
    best = F.struct(-F.col("n_chars"), F.col("key").isNull(), "key", "row")
    groups = rows.groupBy("round", "name").agg(F.count("*").alias("group_size"), F.min(best).alias("best"))
    return rows.join(groups, ["round", "name"]).select(
        F.col("key").alias(key),
        F.col("best.key").alias("keep_id" if key != "keep_id" else "keep"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text stays, with all their columns; ids must be unique and not null."""
    kept = exact_groups(docs, key, text).where("kept").select(F.col(key).alias("__kept"))
    return docs.join(kept, docs[key] == F.col("__kept"), "left_semi")


SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256, n_chars
FROM plain WINDOW w AS (PARTITION BY t ORDER BY n_chars DESC, doc_id)
"""
