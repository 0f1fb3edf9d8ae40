"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodrift.llm import (
    bpe,
    conversations,
    decontamination,
    exact_dedup,
    language,
    main_text,
    minhash,
    pii,
    quality,
    resampling,
    revisits,
    topk,
    toxicity,
)
from heliodrift.llm.tables import stored

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-modified captures of all pages, resolved."""
    records = revisits.page_records(_table(spark, sf_dir, "pages"))
    return revisits.resolve_revisits(records).withColumn("headers", revisits.header_lines("headers"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; its source is the host."""
    docs = _table(spark, sf_dir, "documents")
    return language.languages(docs, host=docs["source"]).drop("mark")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("mark")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.extracted(_table(spark, sf_dir, "pages"))


def op5_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    found = decontamination.contaminated(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.select("doc_id", "item_id", "first_word", "similarity")


def op6_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for each vector whose id is divisible by 100."""
    vectors = _table(spark, sf_dir, "embeddings")
    queries = vectors.where(F.col("vec_id") % 100 == 0)
    return topk.search(stored(topk.build_index(vectors)), queries)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.span_digests(_table(spark, sf_dir, "documents"))


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity categories of every document."""
    return toxicity.toxicity_scores(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.quality_scores(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op10_byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document."""
    return bpe.token_digests(
        _table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired at the least cost."""
    damaged = conversations.damage(_table(spark, sf_dir, "conversations"))
    return conversations.digests(conversations.repair(damaged, damaged["present"]))


def op12_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for the text of every document."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the texts of ``benchmark``, and its rank if it is drawn."""
    docs, target = (_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return resampling.resample(docs, target).drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_revisits": op1_revisits,
    "op2_language": op2_language,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_main_text": op4_main_text,
    "op5_benchmark_passages": op5_benchmark_passages,
    "op6_top_inner_products": op6_top_inner_products,
    "op7_personal_data": op7_personal_data,
    "op8_toxicity_chain": op8_toxicity_chain,
    "op9_quality": op9_quality,
    "op10_byte_tokens": op10_byte_tokens,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_exact_duplicates": op12_exact_duplicates,
    "op13_target_resampling": op13_target_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op1_revisits": revisits.SQL,
    "op3_near_duplicates": minhash.SQL,
    "op5_benchmark_passages": decontamination.SQL,
    "op6_top_inner_products": topk.SQL,
    "op11_conversation_repair": conversations.SQL,
    "op12_exact_duplicates": exact_dedup.SQL,
    "op13_target_resampling": resampling.SQL,
}
