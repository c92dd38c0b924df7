"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

``run`` writes every stage as Parquet into the shared folder and reads it again, so a lost executor costs
tasks of one stage. All stages but the last return the columns of documents, further ones included, whatever
their names. An empty table stays empty through all stages; if no label of a kind is known, the quality
stage scores every document alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from churnlake.llm import chunk_dedup, jaccard_join, packing, personal_data, quality_cnn
from churnlake.llm.common import cut, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels next to the documents.

    Null and empty texts are scored as texts without bytes; rows that repeat an id are judged each on its own."""
    return quality_cnn.accepted(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case; null is empty) the row with the largest id, a null id being the smallest.

    Of rows that repeat an id and its text one stays."""
    return chunk_dedup.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the row with the smallest id.

    Null and empty texts are near nothing; rows with a null id stay."""
    return jaccard_join.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; a null text stays null, all rows stay."""
    return personal_data.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 tokens; a null or empty text is its end token."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("redact", redact), ("pack", pack)]

#: SQL can express neither the classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
