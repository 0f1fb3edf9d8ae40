"""Language of texts by Bayesian fusion of the text with what is declared and where it comes from.

The evidence of a row is added up as logarithms for each language:

* **text**: the mean log-likelihood of its byte trigrams under the language's model, times the
  number of trigrams, at most ``TEXT_WEIGHT`` (the trigrams of a text are not independent);
* **declared markup language**: how often rows that read like the language declare this;
* **address suffix**: how often rows that read like the language have this suffix;
* **host prior**: the share of the language among the rows of the host by their text,
  smoothed towards its domain, which is smoothed towards the whole corpus.

All tables of counts are grouped aggregations over all rows. The trigram models are fitted on
about ``SAMPLE_ROWS`` rows of each declared language, those with the smallest id hash. Every
language that ``MIN_ROWS`` rows declare has one, whatever their share, and every declaration and
every suffix is evidence. One more class, ``und``, stands for text of no language: all trigrams are
equally likely under it. Where only one or two rows declare a language, others must explain
their text.

A declaration is two or three letters, so there are 18,252 languages at most. Their counts are
sparse, a list of buckets for each, and become dense where texts are scored, ``DENSE`` languages at a
time. Counts of declarations and suffixes stay in tables that are joined.

A row is rejected if ``und`` is the most probable, if the best probability is under
``MIN_PROBABILITY``, or if the text (null, empty, without letters) has no trigram. A null
declaration, suffix or host adds nothing or falls back to the corpus; null ids are returned as
they are; repeated rows count as often as they occur; of equal probabilities the first language
in alphabetical order wins; with no declared language at all every row is ``und``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliodrift.llm.batches import map_text
from heliodrift.llm.tables import stored

BUCKETS = 1 << 15
SAMPLE_ROWS = 500
MIN_ROWS = 3
#: Languages whose logarithms a worker holds for all buckets at once.
DENSE = 64
TEXT_WEIGHT = 100
MIN_PROBABILITY = 0.5
#: Rows that the level above counts for, in the smoothing of hosts and domains.
HOST_STRENGTH = 20.0
UNKNOWN = "und"
UNKNOWN_PRIOR = 0.01
_FLOOR = 0.5

_FOLD = np.full(256, 0x20, np.uint8)
_LETTERS = [*range(0x61, 0x7B), *range(0x80, 0x100)]
_FOLD[_LETTERS] = _LETTERS
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter, and the rows' offsets."""
    data = _FOLD[np.frombuffer(b"  " + b"  ".join(texts) + b"  ", np.uint8)].astype(np.uint32)
    centre = np.flatnonzero(data[1:-1] != 0x20) + 1
    codes = (data[centre - 1] << 16) | (data[centre] << 8) | data[centre + 1]
    buckets = ((codes * np.uint32(2_654_435_761)) >> np.uint32(17)).astype(np.int64)
    starts = np.cumsum([2, *(len(x) + 2 for x in texts)])
    return buckets, np.searchsorted(centre, starts)


@dataclass(frozen=True)
class Model:
    """For each language the buckets that its sample holds, and how often."""

    languages: list[str]
    buckets: list[np.ndarray]
    counts: list[np.ndarray]

    def logs(self) -> Iterator[np.ndarray]:
        """The log-probability of every bucket, smoothed, language by language."""
        for buckets, counts in zip(self.buckets, self.counts, strict=True):
            table = np.full(BUCKETS, _FLOOR)
            table[buckets] += counts
            yield np.log(table / table.sum()).astype(np.float32)

    def means(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of trigrams, and their mean log-likelihoods, a column for each language."""
        buckets, at = trigrams(texts)
        counts = np.diff(at)
        out = np.zeros((len(texts), len(self.languages)))
        for k, logs in enumerate(_dense(self)):
            sums = np.concatenate(([0.0], np.cumsum(logs[buckets], dtype=np.float64)))
            out[:, k] = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, counts)
        return counts, out


def _dense(model: Model) -> Iterator[np.ndarray]:
    """The model's logarithms; those of the first ``DENSE`` languages are kept from batch to batch."""
    if _kept.get("model") is not model:
        _kept.clear()
        _kept["model"] = model
        _kept["logs"] = [x for _, x in zip(range(DENSE), model.logs(), strict=False)]
    yield from _kept["logs"]
    if len(model.languages) > DENSE:
        yield from Model(model.languages[DENSE:], model.buckets[DENSE:], model.counts[DENSE:]).logs()


_kept: dict = {}


def primary(declared: Column) -> Column:
    """The primary subtag of a language tag, in lower case; null if there is none."""
    tag = F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def evidence(docs: DataFrame, text: str, declared: str | None, host: Column) -> DataFrame:
    """Text, declaration, host, its domain (last two labels) and suffix of every row."""
    labels = F.split(host, r"\.")
    some = F.size(labels) > 1
    return docs.select(
        "*",
        F.coalesce(text, F.lit("")).alias("__text"),
        (primary(F.col(declared)) if declared else F.lit(None).cast("string")).alias("__declared"),
        host.alias("__host"),
        F.when(some, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).alias("__domain"),
        F.when(some, F.element_at(labels, -1)).alias("__suffix"),
    )


def train(rows: DataFrame, key: str) -> Model:
    """Trigram models of the declared languages of ``evidence`` rows."""
    found = rows.groupBy("__declared").count().where("__declared IS NOT NULL")
    shares = found.where(F.col("count") >= MIN_ROWS).select("__declared", (SAMPLE_ROWS / F.col("count")).alias("share"))
    place = F.pmod(F.xxhash64(key), F.lit(1 << 31)) / float(1 << 31)
    # A row for each language, of which the alphabet allows a bounded number.
    sample = rows.join(F.broadcast(shares), "__declared").where(
        # Few rows are all taken; an id that repeats must not leave them out together.
        (F.col("share") >= 1) | (place < F.col("share"))
    )

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        buckets, at = trigrams([x.encode() for x in batch.column(1).to_pylist()])
        names = batch.column(0).dictionary_encode()
        keys = np.repeat(names.indices.to_numpy().astype(np.int64), np.diff(at)) * BUCKETS + buckets
        keys, sizes = np.unique(keys, return_counts=True)
        arrays = [names.dictionary.take(pa.array(keys // BUCKETS)), pa.array((keys % BUCKETS).astype(np.int32))]
        return pa.record_batch([*arrays, pa.array(sizes.astype(np.int64))], ["language", "bucket", "n"])

    counted = map_text(sample.select("__declared", "__text"), "__text", count, "language string, bucket int, n bigint")
    sums = counted.groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    # One row for each language, with at most as many numbers as there are buckets.
    lists = sums.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"))
    table = lists.select("language", "cells.bucket", "cells.n").orderBy("language").toArrow()
    # A language whose rows have no letter has no model.
    cells = zip(table.column("bucket").to_pylist(), table.column("n").to_pylist(), strict=True)
    arrays = [(np.array(b, np.int32), np.array(n, np.float64)) for b, n in cells]
    return Model(table.column("language").to_pylist(), [b for b, _ in arrays], [n for _, n in arrays])


def text_scores(rows: DataFrame, model: Model, key: str) -> DataFrame:
    """Trigram count and weighted log-likelihoods of every row, ``und`` being the last entry."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = ["__key", "__mark", "__declared", "__host", "__domain", "__suffix"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, means = shared.value.means([x.encode() for x in batch.column("__text").to_pylist()])
        means = np.column_stack((means, np.full(len(counts), -math.log(BUCKETS))))
        logs = means * np.minimum(counts, TEXT_WEIGHT)[:, None]
        arrays = [pa.array(counts.astype(np.int64)), pa.array(list(logs), pa.list_(pa.float64()))]
        return pa.record_batch([*(batch.column(c) for c in kept), *arrays], [*kept, "trigrams", "logs"])

    source = rows.select(F.col(key).alias("__key"), F.xxhash64("__text").alias("__mark"), *kept[2:], "__text")
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in kept)
    return map_text(source, "__text", run, f"{kinds}, trigrams bigint, logs array<double>")


def _tally(counts: DataFrame, *by: str) -> DataFrame:
    """A map from languages to rows, for each value of ``by``."""
    sums = counts.groupBy(*by, "guess").agg(F.sum("count").alias("count"))
    return sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("guess", "count"))).alias("tally"))


def _of(tally: str, name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col(tally), name), F.lit(0))


def _given_language(guesses: DataFrame, column: str, names: list[str], bonus: float) -> DataFrame:
    """For each value of ``column`` the logarithms of its share among each language's rows.

    ``bonus`` rows of each language are taken to declare it.
    """
    counts = guesses.where(F.col(column).isNotNull()).groupBy(column, "guess").count()
    sums = dict(counts.groupBy("guess").agg(F.sum("count")).collect())  # a row for each language
    values = counts.select(column).distinct().count()
    total = F.create_map(*(x for n in names for x in (F.lit(n), F.lit(float(sums.get(n, 0) + bonus + values + 1)))))
    logs = F.transform(
        F.array(*map(F.lit, names)),
        lambda m: F.log(
            (_of("tally", m) + F.when(m == F.col(column), bonus).otherwise(0.0) + 1) / F.element_at(total, m)
        ),
    )
    return _tally(counts, column).select(column, logs.alias(f"{column}_logs"))


def _with_evidence(rows: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``table`` joined by ``column``; rows without a value, and so without a match, stay spread."""
    spread = F.coalesce(F.col(column), F.concat(F.lit("\x00"), (F.col("__mark") % 1_000).cast("string")))
    named = table.withColumnRenamed(column, "__value")
    return rows.withColumn("__value", spread).join(named, "__value", "left").drop("__value")


def host_priors(guesses: DataFrame, names: list[str]) -> tuple[DataFrame, list[float]]:
    """Log-priors of each host, smoothed by its domain's, these by the corpus's; and the corpus's.

    ``guesses`` has a row for each document with ``__host``, ``__domain`` and ``guess``.
    """
    counts = guesses.groupBy("__host", "__domain", "guess").count()
    known = [n for n in names if n != UNKNOWN]
    whole = dict(counts.groupBy("guess").agg(F.sum("count")).collect())  # a row for each language
    total = sum(whole.get(n, 0) for n in known)
    corpus = {n: (1 - UNKNOWN_PRIOR) * (whole.get(n, 0) + 1) / (total + len(known)) for n in known}
    corpus[UNKNOWN] = UNKNOWN_PRIOR
    hosts = _tally(counts.where("__host IS NOT NULL"), "__host", "__domain").withColumnRenamed("tally", "own")
    domains = _tally(counts.where("__domain IS NOT NULL"), "__domain").withColumnRenamed("tally", "around")
    both = hosts.join(domains, "__domain", "left")
    base = F.create_map(*(x for n in names for x in (F.lit(n), F.lit(corpus[n]))))

    def size(tally: str) -> Column:
        values = F.coalesce(F.map_values(tally), F.array().cast("array<bigint>"))
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)

    both = both.withColumns({"own_size": size("own"), "around_size": size("around")})

    def log_prior(name: Column) -> Column:
        domain = (_of("around", name) + HOST_STRENGTH * F.element_at(base, name)) / (F.col("around_size") + HOST_STRENGTH)
        return F.log((_of("own", name) + HOST_STRENGTH * domain) / (F.col("own_size") + HOST_STRENGTH))

    logs = F.transform(F.array(*map(F.lit, names)), log_prior)
    return both.select("__host", logs.alias("__host_logs")), [math.log(corpus[n]) for n in names]


def languages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    declared: str | None = "lang",
    host: Column | None = None,
) -> DataFrame:
    """``key``, ``mark`` (hash of the text), ``language``, ``probability`` and ``kept`` of every row.

    ``host`` is a column of host names; ``host_of`` reads it from a URL.
    """
    rows = evidence(docs, text, declared, F.lit(None).cast("string") if host is None else host)
    model = train(rows, key)
    names = [*model.languages, UNKNOWN]
    scores = stored(text_scores(rows, model, key))
    by_text = F.array(*map(F.lit, names))[F.array_position("logs", F.array_max("logs")).cast("int") - 1]
    guesses = scores.withColumn("guess", by_text)
    priors, corpus = host_priors(guesses, names)
    fused = _with_evidence(scores, priors, "__host")
    for column, bonus in (("__declared", HOST_STRENGTH), ("__suffix", 0.0)):
        fused = _with_evidence(fused, _given_language(guesses, column, names, bonus), column)
    total = F.zip_with("logs", F.coalesce("__host_logs", F.array(*map(F.lit, corpus))), lambda x, y: x + y)
    for column in ("__declared_logs", "__suffix_logs"):
        total = F.zip_with(total, F.coalesce(column, F.array_repeat(F.lit(0.0), len(names))), lambda x, y: x + y)
    fused = fused.select("__key", "__mark", "trigrams", total.alias("total"))
    best = F.array_max("total")
    mass = F.aggregate(F.transform("total", lambda x: F.exp(x - F.array_max("total"))), F.lit(0.0), lambda a, x: a + x)
    out = fused.select(
        "__key",
        "__mark",
        F.when(
            F.col("trigrams") > 0, F.array(*map(F.lit, names))[F.array_position("total", best).cast("int") - 1]
        ).otherwise(UNKNOWN).alias("language"),
        F.when(F.col("trigrams") > 0, 1 / mass).otherwise(0.0).alias("probability"),
    )
    kept = (F.col("language") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY)
    return out.select(F.col("__key").alias(key), F.col("__mark").alias("mark"), "language", "probability", kept.alias("kept"))


def known_language(docs: DataFrame, text: str = "text", **columns) -> DataFrame:
    """``docs`` without the rows that ``languages`` rejects, matched by id and text."""
    found = languages(docs, text=text, **columns)
    key = columns.get("key", "doc_id")
    rejected = stored(found.where(~F.col("kept")).select(F.col(key).alias("__key"), F.col("mark").alias("__mark")))
    same = docs[key].eqNullSafe(F.col("__key")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("__mark"))
    return docs.join(rejected, same, "left_anti")
