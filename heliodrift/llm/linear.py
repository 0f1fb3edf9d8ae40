"""Hashed word n-grams and logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodrift.llm.batches import map_text, sample_ids
from heliodrift.llm.words import mix, word_hashes

BITS = 20
_REPEATED = np.uint64(0x5851F42D4C957F2D)
#: Bound of the labelled rows that a classifier is fitted on.
SAMPLE_ROWS = 6_000


def ngrams(texts: list[bytes], bits: int = BITS, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the single words and word pairs of each text, and the rows' offsets.

    A pair of equal words shares one slot with all such pairs, so that repetition shows
    for words never seen in training.
    """
    words, at = word_hashes(texts, lower=lower, marks=True)
    rows = np.repeat(np.arange(len(texts)), np.diff(at))
    pairs = np.flatnonzero(rows[1:] == rows[:-1])
    both = mix(words[pairs] * np.uint64(0xD1342543DE82EF95) + words[pairs + 1], 2)
    both[words[pairs] == words[pairs + 1]] = _REPEATED
    owner = np.concatenate((rows, rows[pairs]))
    slots = (np.concatenate((words, both)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return slots[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


@dataclass(frozen=True)
class Features:
    """How slots become values: shares ``tf / sqrt(n)`` of a text's n-grams, or presence.

    ``beginnings`` adds slots for the first so many bytes of each word, for inflected forms.
    """

    bits: int = BITS
    presence: bool = False
    lower: bool = False
    beginnings: tuple[int, ...] = ()

    def rows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct slots of each row, their values and the rows' offsets."""
        slots, at = ngrams(texts, self.bits, self.lower)
        owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(at))
        for size in self.beginnings:
            words, inner = word_hashes(texts, lower=self.lower, marks=True, first=size)
            begun = (mix(words, size) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            slots = np.concatenate((slots, begun))
            owner = np.concatenate((owner, np.repeat(np.arange(len(texts)), np.diff(inner))))
        keys, counts = np.unique((owner << self.bits) | slots, return_counts=True)
        owner = keys >> self.bits
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        values = np.ones(len(keys)) if self.presence else counts / np.sqrt(np.maximum(1, np.diff(at)))[owner]
        return keys & ((1 << self.bits) - 1), values.astype(np.float32), ends


def sparse_dots(weights: np.ndarray, slots: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The dot product of each row with ``weights``, whose last entry is the bias."""
    sums = np.concatenate(([0.0], np.cumsum(weights[slots] * values, dtype=np.float64)))
    return sums[at[1:]] - sums[at[:-1]] + weights[-1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class Rates:
    """Settings of the updates; ``l1`` keeps coordinates without a steady signal at zero."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.1
    epochs: int = 3


class FollowTheLeader:
    """Logistic regression by FTRL-proximal updates, one row after another.

    Per-coordinate rates fall with the gradients seen.
    """

    def __init__(self, size: int, rates: Rates) -> None:
        self.z, self.n, self.rates = np.zeros(size), np.zeros(size), rates

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        r = self.rates
        shrunk = np.sign(z) * np.maximum(np.abs(z) - r.l1, 0)
        return -shrunk / ((r.beta + np.sqrt(n)) / r.alpha + r.l2)

    def update(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        z, n = self.z[slots], self.n[slots]
        weights = self._weights(z, n)
        gradient = (float(sigmoid(weights @ values)) - label) * values
        grown = n + gradient * gradient
        self.z[slots] = z + gradient - (np.sqrt(grown) - np.sqrt(n)) / self.rates.alpha * weights
        self.n[slots] = grown

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n)


def fit(rows: Iterable[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, rates: Rates) -> np.ndarray:
    """Weights over ``size`` slots; the last slot is the bias and must not be in ``rows``.

    ``rows`` are gone through once an epoch.
    """
    learner = FollowTheLeader(size, rates)
    bias, one = np.array([size - 1], np.int32), np.ones(1, np.float32)
    for _ in range(rates.epochs):
        for (slots, values), label in zip(rows, labels, strict=True):
            learner.update(np.concatenate((slots, bias)), np.concatenate((values, one)), float(label))
    return learner.weights().astype(np.float32)


def sparse_batch(models: list[np.ndarray], names: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each model: its weights that are not zero. Schema ``SPARSE``.

    ``names`` are the slots that the places of a model stand for, if not the places themselves.
    """
    places = [np.flatnonzero(w) for w in models]
    slots = places if names is None else [names[i] for i in places]
    return pa.record_batch(
        [
            pa.array(range(len(models)), pa.int32()),
            pa.array(slots, pa.list_(pa.int32())),
            pa.array([w[i] for w, i in zip(models, places, strict=True)], pa.list_(pa.float32())),
        ],
        ["model", "slots", "weights"],
    )


SPARSE = "model int, slots array<int>, weights array<float>"


def dense(rows: list, models: int, size: int) -> np.ndarray:
    """The ``models`` of ``sparse_batch`` as a matrix; zeros if an empty sample ran no task."""
    out = np.zeros((models, size), np.float32)
    for row in rows:
        out[row["model"], row["slots"]] = row["weights"]
    return out


def labelled_sample(
    docs: DataFrame, labels: DataFrame, columns: list[str], features: Features, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Features and labels of ``rows`` labelled documents at most, those of the smallest id hash.

    A repeated label row counts once, by its largest label; rows without a label or an id
    are left out, and so are labels without a document. Of the rows of one id the least text counts,
    chosen before any shuffle, so an id that holds a third of the rows is one row of the sample.
    """
    named = labels.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns)).dropna()
    # At most ``rows`` ids leave the sample, so their size is bounded.
    chosen = sample_ids(named, "doc_id", rows).join(named, "doc_id")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    once = texts.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = once.join(F.broadcast(chosen), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots, values, at = features.rows([x.encode() for x in batch.column("text").to_pylist()])
        lists = [
            pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, kind))
            for x, kind in ((slots, pa.int32()), (values, pa.float32()))
        ]
        kept = [batch.column(c) for c in ("doc_id", *columns)]
        return pa.record_batch([*kept, *lists], ["doc_id", *columns, "slots", "values"])

    schema = ", ".join(
        f"{c} {texts.schema[c].dataType.simpleString()}" for c in ("doc_id", *columns)
    )
    order = texts.select("doc_id", "text", *columns)
    return map_text(order, "text", run, f"{schema}, slots array<int>, values array<float>")
