"""Registered queries of this subpackage: thin calls of its operators with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import (
    collocations,
    conversation,
    decontamination,
    embedding_dedup,
    html_text,
    language_id,
    mixing,
    ngram_join,
    pii,
    quality,
    sharding,
    token_counts,
    toxicity,
)
from tidebook.llm.common import table

SHARDS = 16
Query = Callable[[SparkSession, str], DataFrame]


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 of all documents under the law ``key``."""
    return sharding.shard_plan(table(spark, sf_dir, "documents", "doc_id", "text"), [1.0] * SHARDS)


def op2_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_flat_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), least=0.9)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, starting from an empty cache."""
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the model that the labels outside the held-out third give."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(~language_id.held_out(F.col("doc_id"), 3, 1))
    scores = quality.scored(docs, quality.fit(docs, labels))
    held = language_id.held_out(F.col("doc_id"), 3, 1).alias("held_out")
    return scores.select(F.col("doc_id").cast("long").alias("doc_id"), held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, links and groups of all documents on runs of five words at Jaccard 0.8."""
    return ngram_join.similar_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, with the item."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.drop("text_hash")


def op10_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from samples outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = language_id.held_out(F.col("doc_id"), 4, 2)
    found = language_id.identify(docs, language_id.learn(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by voters and labels outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = language_id.held_out(F.col("doc_id"), 4, 2)
    scores = toxicity.toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held))
    return scores.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage by checksum."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversation.repair_report(rows, conversation.damaged(rows))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents", "lang", "text"), support=100, most=2000)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_rendezvous_shards,
        op2_template_removal,
        op3_flat_graph_dedup,
        op4_token_counts,
        op5_pairwise_quality,
        op6_source_mix,
        op7_contextual_pii,
        op8_chosen_path_join,
        op9_template_decontamination,
        op10_cross_parsing_language,
        op11_weak_toxicity,
        op12_conversation_repair,
        op13_phrase_collocations,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_source_mix": mixing.SQL, "op13_phrase_collocations": collocations.SQL}
