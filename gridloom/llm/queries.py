"""The queries of this subpackage and their SQL. Each runs over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bitpack, bpe, chat, divergence, exact_dedup, html, jaccard, mixing, periodic, quality, toxicity, vectors, warc
from gridloom.llm.common import load

BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"
WORD_IDS = 49_408
END_ID = 2


def op1_token_binary(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read back from the packed files."""
    path = vocabulary or public_tokenizers.path(WORD_VOCABULARY)
    return bitpack.read_packed(bitpack.write_packed(load(spark, sf_dir, "documents"), path, WORD_IDS, END_ID))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents."""
    return jaccard.join(load(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, topic, n_tokens, probability, kept of all documents."""
    return mixing.drawn(load(spark, sf_dir, "documents")).select("doc_id", "topic", "n_tokens", "probability", "kept")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted texts."""
    extra = spark.createDataFrame([(chat.EXTRA_ID, i, role, chat.EXTRA_TEXT) for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return chat.read_formatted(chat.format_log(chat.message_log(rows), distinct_turns=True))


def op5_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all embeddings."""
    return vectors.near_duplicates(load(spark, sf_dir, "embeddings"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of all documents."""
    return exact_dedup.dedup(load(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of all pages."""
    return html.main_texts(load(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of all documents."""
    path = vocabulary or public_tokenizers.path(BYTE_VOCABULARY)
    return bpe.digests(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the archives."""
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    docs = load(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, load(spark, sf_dir, "labels")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent and two digests, of all documents with their planted periods."""
    return periodic.digests(load(spark, sf_dir, "documents"), periodic.planted)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over all documents."""
    return divergence.audit(load(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_binary": op1_token_binary,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_mixing": op3_mixing,
    "op4_chat": op4_chat,
    "op5_embedding_near_dup": op5_embedding_near_dup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_html": op8_html,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_warc": op10_warc,
    "op11_quality": op11_quality,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES = {"op2_ngram_jaccard": jaccard.ORACLE, "op3_mixing": mixing.oracle(), "op4_chat": chat.ORACLE, "op5_embedding_near_dup": vectors.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op10_warc": warc.ORACLE, "op13_source_divergence": divergence.oracle()}
