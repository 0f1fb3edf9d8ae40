"""Quality: logistic regression on hashed word n-grams, learnt by FTRL, scored as sparse dots.

Words and pairs of words are hashed to 2**20 slots; a row's values are its counts over the
root of their number. The model is fitted in one task on at most ``SAMPLE_ROWS`` labelled
rows; its weights (4 MB at most) are broadcast and every text is scored whole, in batches.

A null text is scored like an empty one, which is the bias alone; ids may repeat or be null;
columns besides id and text are not read; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodrift.llm.batches import held_out, map_text
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

FEATURES = Features()
RATES = Rates()
THRESHOLD = 0.3


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights of the label's classifier, from at most ``rows`` rows of ``labels``."""
    sample = labelled_sample(docs, labels, [label], FEATURES, rows)
    size = (1 << FEATURES.bits) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [r for b in batches for r in zip(*(b.column(c) for c in ("slots", "values", label)), strict=True)]
        data = [(s.values.to_numpy(), v.values.to_numpy()) for s, v, _ in seen]
        yield sparse_batch([fit(data, np.array([y.as_py() for _, _, y in seen]), size, RATES)])

    # One task for a sample of bounded size, in an order that the partitions don't change.
    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    return dense(ordered.mapInArrow(run, SPARSE).collect(), 1, size)[0]


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score``, the probability of label 1, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x.encode() for x in batch.column(1).to_pylist()]
        scores = sigmoid(sparse_dots(shared.value, *FEATURES.rows(texts)))
        return pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return map_text(source, "text", run, f"key {kind}, score double").withColumnRenamed("key", key)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every document by labels outside the held-out fifth."""
    weights = train(docs, labels.where(~held_out("doc_id")).select("doc_id", "quality"))
    return score(docs, weights).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
