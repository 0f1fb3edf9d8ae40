"""The corpus pipeline: five stages over ``documents``, each over the written rows of the one before.

Rows without text or in no known language go first, then all but one document of each group
of near duplicates, then documents that hold benchmark items; in the rest personal data are
masked, and the result is the token ids and their digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heliodrift.llm import bpe, decontamination, language, minhash, pii
from heliodrift.llm.queries import RANKS
from heliodrift.llm.tables import stored


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the source is the host."""
    host = docs["source"].cast("string") if "source" in docs.columns else None
    return language.known_language(docs, host=host)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id in each group of near duplicates, once."""
    return minhash.without_duplicates(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like an item of ``benchmark``."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data masked."""
    return pii.masked_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the decoded bytes."""
    return bpe.token_digests(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("language", keep_known_languages),
    ("near duplicates", keep_one_of_each_group),
    ("benchmark passages", drop_benchmark_passages),
    ("personal data", mask_personal_data),
    ("byte tokens", encode_tokens),
]

#: Language models, patterns with checksums and merges are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
