"""Near-duplicate documents by one-permutation MinHash with optimal densification.

A document is the set of its distinct five-word shingles (A-Z folded). One hash deals the
shingles to ``BINS`` bins and each bin keeps its least; an empty bin copies from bins named by
its own series of hashes until one is filled, so tiny sets still agree with the probability of
their similarity. ``BANDS`` bands of ``BINS / BANDS`` bins are the buckets: at a similarity of
0.75 a pair misses all of them with a probability of 5e-6.

1. Equal sets become one class; only its least id goes on, so copies make no pairs.
2. In each bucket every member is paired with the hub alone, the member that meets most others
   over all its buckets: one pair for a member and bucket at most.
3. Pairs that a bound rules out are dropped, the others are confirmed on the full sets, and the
   links give components. The bounds lose nothing: sizes, and the bits in which bitmaps of the
   sets differ (half of what they leave is the most two sets can share).
4. A bucket whose members are still in different components may hide a link between two of
   them. Its members are not paired with each other: such documents meet by their rarest shingles.
   Similar sets share one of the first ``size - ceil(0.75 * size) + 1`` of their shingles, in the order
   of how many of these documents have them, and at places that leave enough behind them. The
   number of shingles that occur in any other such document is a third bound there. The pairs
   that stay open are confirmed in the same way, which completes the links.

Null and empty texts, and texts without words, have no shingles and are linked with nothing.
A row with a null id is not linked and stays; repeated rows get the same result each; ties
of hubs go to the smaller id; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliodrift.llm.batches import map_text
from heliodrift.llm.components import components
from heliodrift.llm.tables import stored
from heliodrift.llm.words import mix, row_shingles, word_hashes

BINS = 128
BANDS = 32
PERCENT = 75
#: Bits of the bitmaps that bound what two sets share.
BITMAP_BITS = 2_048
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_EDGES = np.arange(BINS, dtype=np.uint64) << _SHIFT
_NUMBERS = ("id", "mark", "n_shingles", "print1", "print2")


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [np.unique(x) for x in row_shingles(*word_hashes(texts))]


def densify(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the first filled bin in a series of their own."""
    out = values.copy()
    rows, bins = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    attempt = 0
    while len(rows):
        source = (mix((bins * 65_537 + attempt).astype(np.uint64), 3) % np.uint64(BINS)).astype(np.int64)
        hit = filled[rows, source]
        out[rows[hit], bins[hit]] = values[rows[hit], source[hit]]
        rows, bins, attempt = rows[~hit], bins[~hit], attempt + 1
    return out


def one_permutation(sets: list[np.ndarray]) -> np.ndarray:
    """The densified least hash of each bin; a row of zeros for an empty set."""
    values = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for row, items in enumerate(sets):
        if len(items):
            at = np.searchsorted(items, _EDGES)
            filled[row] = at < np.append(at[1:], len(items))
            values[row] = items[np.minimum(at, len(items) - 1)]
    return densify(values, filled)


def _bands(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(len(values), BANDS, BINS // BANDS)
    keys = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64), 4), rows.shape[:2])
    for k in range(rows.shape[2]):
        keys = mix(keys * np.uint64(0xD1342543DE82EF95) + rows[:, :, k], k)
    return keys


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Size, fingerprint and buckets of every row's shingle set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([x.encode() for x in batch.column(1).to_pylist()])
        sizes = np.array([len(x) for x in sets], np.int64)
        prints = [np.array([mix(x, k).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64) for k in (1, 2)]
        bands = [list(b) if n else [] for b, n in zip(_bands(one_permutation(sets)).view(np.int64), sizes, strict=True)]
        columns = [batch.column(0), batch.column(2), sizes, *prints]
        arrays = [x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)) for x in columns]
        names = [*_NUMBERS, "bands"]
        return pa.record_batch([*arrays, pa.array(bands, pa.list_(pa.int64()))], names)

    source = docs.select(docs[key].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    source = source.withColumn("mark", F.xxhash64("text"))
    numbers = ", ".join(f"{c} bigint" for c in _NUMBERS)
    return map_text(source, "text", run, f"{numbers}, bands array<bigint>")


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BITMAP_BITS), bool)
    for row, items in enumerate(sets):
        out[row, (mix(items, 8) % np.uint64(BITMAP_BITS)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.int64)


def _full_sets(docs: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """The shingle sets of the documents in ``ids`` and their bitmaps."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([x.encode() for x in batch.column(1).to_pylist()])
        bitmaps = pa.array(list(_bitmaps(sets)), pa.list_(pa.int64()))
        items = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
        return pa.record_batch([batch.column(0), items, bitmaps], ["id", "items", "bitmap"])

    source = docs.select(docs[key].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    schema = "id bigint, items array<bigint>, bitmap array<bigint>"
    return map_text(source.join(ids, "id", "left_semi"), "text", run, schema)


def _similar(common: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def _differing(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _bitmaps_fit(left: str, right: str, percent: int) -> Column:
    """What sizes and bitmaps leave open; neither rules out a similar pair."""
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    words = range(BITMAP_BITS // 64)
    bits = sum((_differing(F.col(f"{left}.bitmap")[k], F.col(f"{right}.bitmap")[k]) for k in words), F.lit(0))
    return _sizes_fit(a, b, percent) & _similar((a + b - bits) / 2, a, b, percent)


def _can_share(left: str, right: str, percent: int) -> Column:
    """Whether enough can be common, by the shingles found elsewhere and by the bitmaps."""
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    common = F.least(f"{left}.elsewhere", f"{right}.elsewhere")
    return _similar(common, a, b, percent) & _bitmaps_fit(left, right, percent)


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (``hub``, ``id``) whose full sets are similar enough."""
    items = sets.select("id", "items")
    hubs = sets.select(F.col("id").alias("hub"), F.col("items").alias("hub_items"))
    both = pairs.join(items, "id").join(hubs, "hub")
    common = F.size(F.array_intersect("items", "hub_items"))
    test = _similar(common, F.size("items"), F.size("hub_items"), percent)
    return stored(both.where(test).select("hub", "id").distinct())


def link_table(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, size, prints), classes of equal sets (prints, id), and links between classes."""
    rows = stored(signatures(docs, key, text))
    # Only the group columns and the least id are shuffled for copies, after a map-side combine.
    classes = stored(
        rows.where("n_shingles > 0 AND id IS NOT NULL")
        .groupBy("print1", "print2")
        .agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n_shingles", "bands")))
    )
    marks = classes.select("id", "n_shingles")
    bands = classes.select("id", F.explode("bands").alias("bucket"))
    crowded = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = stored(bands.join(crowded, "bucket"))
    weights = members.groupBy("id").agg(F.sum("members").alias("weight"))
    rank = F.struct("weight", (-F.col("id")).alias("back")).alias("rank")
    hubs = members.join(weights, "id").select("bucket", rank).groupBy("bucket").agg((-F.max("rank")["back"]).alias("hub"))
    stars = members.join(hubs, "bucket").where("id <> hub").select("hub", "id").distinct()
    sets = stored(_full_sets(docs, key, text, weights.select("id")))
    known = marks.join(sets.select("id", "bitmap"), "id").select("id", F.struct("n_shingles", "bitmap").alias("a"))
    others = known.select(F.col("id").alias("hub"), F.col("a").alias("b"))
    pairs = stars.join(known, "id").join(others, "hub").where(_bitmaps_fit("a", "b", percent))
    pairs = stored(pairs.select("hub", "id"))
    links = _confirmed(sets, pairs, percent)
    more = stored(_left_over(members, sets, links, pairs, percent))
    if not more.isEmpty():
        links = links.unionByName(_confirmed(sets, more, percent))
    return rows, classes, links


def _left_over(members: DataFrame, sets: DataFrame, links: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components, of buckets that hold several, that may be similar and were not tested."""
    found = components(links, "hub", "id").withColumnRenamed("node", "id")
    labelled = members.select("bucket", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (
        labelled.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("bucket")
    )
    open_rows = stored(labelled.join(mixed, "bucket").select("id", "component").distinct())
    open_sets = sets.join(open_rows.select("id"), "id", "left_semi")
    tokens = open_sets.select("id", F.explode("items").alias("item"))
    found_in = tokens.groupBy("item").agg(F.count("*").alias("n"))
    # Each document's shingles, rarest first: no more than its own set.
    ranked = (
        tokens.join(found_in, "item")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("ranked"))
        .join(open_rows, "id")
    )
    size = F.size("ranked").cast("long")
    # A shingle of no other open document cannot be common to two of them.
    elsewhere = F.size(F.filter("ranked", lambda t: t["n"] > 1)).cast("long")
    ranked = ranked.withColumns({"n_shingles": size, "elsewhere": elsewhere})
    # The least another document must share: with one of ``percent`` of its size, all of that.
    ranked = stored(ranked.where(100 * F.col("elsewhere") >= percent * F.col("n_shingles")))
    least = F.ceil(F.col("n_shingles") * percent / 100)
    first = F.slice("ranked", F.lit(1), (F.col("n_shingles") - least + 1).cast("int"))
    places = ranked.select("id", "component", "n_shingles", F.posexplode(first).alias("place", "token"))
    places = places.where("token.n > 1").select(
        "token.item", F.struct("id", "component", "n_shingles", "place").alias("x")
    )
    different = F.col("a.component") < F.col("b.component")
    behind = F.least(F.col("a.n_shingles") - F.col("a.place"), F.col("b.n_shingles") - F.col("b.place"))
    meet = (
        places.withColumnRenamed("x", "a")
        .join(places.withColumnRenamed("x", "b"), "item")
        .where(different & _similar(behind, F.col("a.n_shingles"), F.col("b.n_shingles"), percent))
        .select(F.col("a.id").alias("hub"), F.col("b.id").alias("id"))
        .distinct()
    )
    known = ranked.select("id", "n_shingles", "elsewhere").join(open_sets.select("id", "bitmap"), "id")
    known = known.select("id", F.struct("n_shingles", "elsewhere", "bitmap").alias("x"))
    others = known.select(F.col("id").alias("hub"), F.col("x").alias("a"))
    pairs = meet.join(known.withColumnRenamed("x", "b"), "id").join(others, "hub")
    pairs = pairs.where(_can_share("a", "b", percent)).select("hub", "id")
    done = tested.select(F.least("hub", "id").alias("low"), F.greatest("hub", "id").alias("high"))
    return pairs.join(
        done, (F.least("hub", "id") == F.col("low")) & (F.greatest("hub", "id") == F.col("high")), "left_anti"
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row of ``docs``.

    ``mark``, a hash of the text, tells rows of one id apart.
    """
    rows, classes, links = link_table(docs, key, text, percent)
    found = components(links, "hub", "id").withColumnRenamed("node", "id")
    labels = classes.select("print1", "print2", "id").join(found, "id", "left")
    labels = labels.select("print1", "print2", F.coalesce("component", "id").alias("component"))
    # Rows without id or shingles match no class, having no prints to match by.
    known = F.expr("n_shingles > 0 AND id IS NOT NULL")
    prints = [F.when(known, F.col(c)).alias(c) for c in ("print1", "print2")]
    out = rows.select("id", "n_shingles", "mark", *prints).join(labels, ["print1", "print2"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        "mark",
    )


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` does not keep.

    Rows of one id and text count once; rows with a null id stay.
    """
    found = stored(near_duplicates(docs, key, text).select("doc_id", "mark", "kept"))
    own = [docs[key].cast("long"), F.xxhash64(F.coalesce(docs[text], F.lit("")))]

    def matched(df: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        named = rows.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
        return df.join(named, (own[0] == F.col("__id")) & (own[1] == F.col("__mark")), how)

    left = matched(docs, found.where("NOT kept").distinct(), "left_anti")
    again = stored(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id", "mark").count().where("count > 1"))
    if again.isEmpty():
        return left
    once = matched(left, again, "left_semi").dropDuplicates([key, text])
    return matched(left, again, "left_anti").unionByName(once)


#: DuckDB SQL over ``documents`` for the result of ``near_duplicates``.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * shared >= 75 * (n + m - shared)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, w.y FROM reach r JOIN ways w ON w.x = r.y)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = s.doc_id
"""
