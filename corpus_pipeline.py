"""From raw documents to packed training sequences: quality rules, language, near duplicates, packing.

Each stage takes the session, the documents its predecessor kept and the folder of the tables, and returns the documents
that it keeps, with their columns as they were; the last returns the pieces of the packed sequences with their ids.
Documents without words, or of an unrecognised language (one that the table does not name, or no language at all), go in
the first two stages; NULL ids pass through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webstrata.llm import language, packing, parity_join, quality
from webstrata.llm.common import stored, table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees, which are fitted to the labelled ones among them."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the table names, recognised from their text."""
    path = tokenizer_path("piece_bpe_32k.model")
    return language.kept(docs, language.fit(docs, path), path)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return parity_join.kept(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their ids."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, keep_ids=True)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("n-gram Jaccard join", ngram_jaccard_join), ("packing", pack)]

# boosted trees and piece models are beyond SQL; the tests compare the stages with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name.lower()))
    return STAGES[-1][1](spark, docs, sf_dir)
