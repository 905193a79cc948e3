"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (filter_audit, language, main_text, near_vectors, oracles, packing, parity_join, piece_trie, quality, quotes, secret_novelty, token_output,
               toxicity, transform_codes)
from .common import crc_mod, table, tokenizer_path

WORD_BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_output.token_digest(table(spark, folder, "documents"), WORD_BPE, end_id=2)


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    trees = quality.fit(docs, table(spark, folder, "labels"))
    return quality.judge(docs.select("doc_id", "text"), trees).select("doc_id", "quality.*")


def op3_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, folder, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op4_quote_links(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.conversations_in_reply_order(table(spark, folder, "conversations"))


def op5_parity_join(spark: SparkSession, folder: str) -> DataFrame:
    return parity_join.parity_components(table(spark, folder, "documents"))


def op6_piece_trie(spark: SparkSession, folder: str) -> DataFrame:
    return piece_trie.piece_digest(table(spark, folder, "documents"), tokenizer_path(PIECES))


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return pages.select("page_id", "url", main_text.extracted(F.col("html")).alias("made")).select("page_id", "url", "made.*")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = crc_mod("doc_id", 4) == 2
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    return (docs.select("doc_id", toxicity.scored(F.col("text"), model).alias("made"))
            .select("doc_id", held_out.alias("held_out"), "made.*"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents"), tokenizer_path(PIECES)
    held_out = crc_mod("doc_id", 3) == 1
    model = language.fit(docs.where(~held_out), path)
    return language.identify(docs.select("doc_id", "text"), model, path).select("doc_id", held_out.alias("held_out"), "language.*")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path(WORD_BPE), end_id=1)


def op11_transform_codes(spark: SparkSession, folder: str) -> DataFrame:
    made, books = transform_codes.transform_codes(table(spark, folder, "embeddings"))
    return made.select("vec_id", "code", "error", "label_error", F.lit(transform_codes.digest(books)).alias("codebooks_sha256"))


def op12_secret_novelty(spark: SparkSession, folder: str) -> DataFrame:
    return secret_novelty.span_digest(table(spark, folder, "documents"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_vectors": op3_near_vectors,
    "op4_quote_links": op4_quote_links,
    "op5_parity_join": op5_parity_join,
    "op6_piece_trie": op6_piece_trie,
    "op7_main_text": op7_main_text,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_transform_codes": op11_transform_codes,
    "op12_secret_novelty": op12_secret_novelty,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op3_near_vectors": oracles.NEAR_VECTORS,
    "op4_quote_links": oracles.QUOTE_LINKS,
    "op5_parity_join": oracles.PARITY_JOIN,
    "op11_transform_codes": oracles.TRANSFORM_CODES,
    "op13_filter_audit": oracles.FILTER_AUDIT,
}
