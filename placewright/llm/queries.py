"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm.chaining import passages
from placewright.llm.chats import format_chats
from placewright.llm.conversation_trie import grafted, op13_digest
from placewright.llm.fingerprints import fingerprint_documents
from placewright.llm.hard_negatives import hard_negatives
from placewright.llm.jaccard_join import join_documents
from placewright.llm.licenses import license_summary
from placewright.llm.line_dedup import dedup_lines
from placewright.llm.mixing import mix
from placewright.llm.oracles import ORACLES
from placewright.llm.pieces import encode
from placewright.llm.pivots import top_k
from placewright.llm.suffix_dedup import cut
from placewright.llm.tables import read
from placewright.llm.toxicity import score_documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that stay, as a digest."""
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_equal", "n_near", kept)


def op2_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(read(spark, sf_dir, "documents")).drop("kept")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_summary(read(spark, sf_dir, "documents"))


def changed_label() -> Column:
    """The label that counts: every seventh row has the one after its own."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read(spark, sf_dir, "embeddings"), changed_label())


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_digest(grafted(read(spark, sf_dir, "conversations")).nodes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_top_k_search": op2_top_k_search,
        "op3_toxicity": op3_toxicity,
        "op4_suffix_array_dedup": op4_suffix_array_dedup,
        "op5_document_fingerprints": op5_document_fingerprints,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_mixing": op8_mixing,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_license_scan": op11_license_scan,
        "op12_hard_negative_mining": op12_hard_negative_mining,
        "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
