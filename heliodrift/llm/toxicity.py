"""Toxicity: a chain of linear models over categories, trained on out-of-fold predictions.

Categories are predicted in order. Each model is logistic regression (FTRL) on the presence
of hashed words, word pairs and word beginnings, and on the probabilities of all earlier categories. In
training these come from models that have not seen the row: rows are dealt to ``FOLDS`` folds
by a hash of the id, and each fold is predicted by models of the other folds. The final
models are fitted on all rows of the sample, which has at most ``SAMPLE_ROWS`` rows.

A null text counts as empty; ids may repeat or be null; other columns are not read; without
labelled rows every probability is 0.5 and nothing is predicted to be toxic, which takes more than
``THRESHOLD``; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliodrift.llm.batches import free_memory, held_out, map_text
from heliodrift.llm.linear import (
    SAMPLE_ROWS,
    SPARSE,
    Features,
    Rates,
    dense,
    fit,
    labelled_sample,
    sigmoid,
    sparse_batch,
    sparse_dots,
)
from heliodrift.llm.words import mix

FEATURES = Features(bits=22, presence=True, lower=True, beginnings=(4, 6))
RATES = Rates(alpha=1.0, l1=10.0, epochs=5)
FOLDS = 3
THRESHOLD = 0.5
#: Common words that insult a person, and words that call something worthless.
INSULTS = ("idiot", "moron", "loser", "clown", "fool", "scum", "jerk", "imbecile", "creep")
CONTEMPT = ("stupid", "worthless", "pathetic", "disgusting", "trash", "garbage", "vile", "filthy")
CATEGORIES = ("insult", "contempt", "toxic")


@dataclass(frozen=True)
class _Extended:
    """Rows with the earlier categories' probabilities in the slots from ``first`` on.

    Put together as they are read, so that no model of the chain keeps a copy of the sample.
    """

    rows: Sequence[tuple[np.ndarray, np.ndarray]]
    probabilities: np.ndarray
    first: int

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        slots = np.arange(self.first, self.first + self.probabilities.shape[1], dtype=np.int32)
        for (s, v), p in zip(self.rows, self.probabilities.astype(np.float32), strict=True):
            yield np.concatenate((s, slots)), np.concatenate((v, p))

    def take(self, places: np.ndarray) -> _Extended:
        return _Extended([self.rows[i] for i in places], self.probabilities[places], self.first)


def _predict(weights: np.ndarray, rows) -> np.ndarray:
    return np.array([sigmoid(weights[s] @ v + weights[-1]) for s, v in rows])


def fit_chain(
    rows, labels: np.ndarray, folds: np.ndarray, bits: int = FEATURES.bits, slots: int | None = None
) -> list[np.ndarray]:
    """One array of weights for each column of ``labels``, in the order of the chain.

    The rows have ``slots`` slots, by default as many as ``bits`` can name.
    """
    count = labels.shape[1]
    first = 1 << bits if slots is None else slots
    size = first + count + 1
    out, earlier = [], np.zeros((len(rows), 0))
    for k in range(count):
        data = _Extended(rows, earlier, first)
        guesses = np.full(len(rows), 0.5)
        for fold in range(FOLDS if k + 1 < count else 0):
            inside = np.flatnonzero(folds == fold)
            outside = np.flatnonzero(folds != fold)
            weights = fit(data.take(outside), labels[outside, k], size, RATES)
            guesses[inside] = _predict(weights, data.take(inside))
        out.append(fit(data, labels[:, k], size, RATES))
        earlier = np.column_stack((earlier, guesses))
    return out


def fit_compact(rows, labels: np.ndarray, folds: np.ndarray, bits: int = FEATURES.bits) -> pa.RecordBatch:
    """The chain over the slots that occur, which are few of those that ``bits`` can name."""
    taken = np.zeros(1 << bits, bool)
    for slots, _ in rows:
        taken[slots] = True
    used = np.flatnonzero(taken)
    del taken
    compact = [(np.searchsorted(used, s).astype(np.int32), v) for s, v in rows]
    chain = fit_chain(compact, labels, folds, slots=len(used))
    return sparse_batch(chain, np.concatenate((used, (1 << bits) + np.arange(labels.shape[1] + 1))))


def train(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, rows: int = SAMPLE_ROWS
) -> np.ndarray:
    """Weights of the chain; ``labels`` has ``doc_id`` and a 0/1 column for each category."""
    sample = labelled_sample(docs, labels, list(categories), FEATURES, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, truth, ids = [], [], []
        for batch in batches:
            lists = zip(batch.column("slots"), batch.column("values"), strict=True)
            data += [(s.values.to_numpy(), v.values.to_numpy()) for s, v in lists]
            truth += zip(*(batch.column(c).to_pylist() for c in categories), strict=True)
            ids += batch.column("doc_id").to_pylist()
        folds = mix(np.array(ids, np.int64).view(np.uint64), 5) % np.uint64(FOLDS)
        yield fit_compact(data, np.array(truth, float).reshape(-1, len(categories)), folds)
        # The next task of this worker scores; it needs the memory.
        data.clear()
        free_memory()

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    size = (1 << FEATURES.bits) + len(categories) + 1
    return dense(ordered.mapInArrow(run, SPARSE).collect(), len(categories), size)


def score(
    docs: DataFrame, chain: np.ndarray, categories: Sequence[str] = CATEGORIES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key`` and the probability of each category for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    first = 1 << FEATURES.bits

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = FEATURES.rows([x.encode() for x in batch.column(1).to_pylist()])
        found: list[np.ndarray] = []
        for weights in shared.value:
            value = sparse_dots(weights, *rows)
            for k, p in enumerate(found):
                value = value + weights[first + k] * p
            found.append(sigmoid(value))
        return pa.record_batch([batch.column(0), *map(pa.array, found)], ["key", *categories])

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    schema = ", ".join([f"key {kind}", *(f"{c} double" for c in categories)])
    return map_text(source, "text", run, schema).withColumnRenamed("key", key)


def _any_word(words: Sequence[str]) -> Column:
    return F.coalesce(F.col("text"), F.lit("")).rlike(rf"(?i)\b({'|'.join(words)})\b")


def category_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Category labels where only one toxicity label is given.

    A row labelled toxic counts for a finer category if its text has one of its words.
    """
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = F.broadcast(known.where(F.col("toxic") == 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    words = (
        docs.join(toxic.select("doc_id"), "doc_id")
        .groupBy("doc_id")
        .agg(
            F.max(_any_word(INSULTS).cast("int")).alias("insult"),
            F.max(_any_word(CONTEMPT).cast("int")).alias("contempt"),
        )
    )
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("insult", "contempt")]
    return known.join(words, "doc_id", "left").select("doc_id", *filled, "toxic")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Category probabilities and the decision on every document.

    Labels of the held-out fifth are not learnt from.
    """
    docs = docs.select("doc_id", "text")
    chain = train(docs, category_labels(docs, labels.where(~held_out("doc_id"))))
    return score(docs, chain).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        *(F.col(c).alias(f"p_{c}") for c in CATEGORIES),
        (F.col("toxic") > THRESHOLD).cast("int").alias("predicted"),
    )
