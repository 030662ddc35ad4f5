"""The corpus pipeline over ``documents``: toxicity, near copies, repeated passages, secrets, packing.

Every stage takes all rows that the one before it has kept.  The first four give the columns of
``documents`` (``n_chars`` follows the text where a stage changes it), the last the packed pieces.

Defined cases are those of the operators: null and empty texts pass the filters, rows with null ids stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm import minhash, packing, queries, secrets, suffixes, toxicity
from rankfold.llm.common import free_name, stored, table


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """``n_chars`` made to follow the text, in the order of the columns before."""
    if "n_chars" in before.columns:
        after = after.withColumn("n_chars", F.char_length("text").cast(before.schema["n_chars"].dataType))
    return after.select(*(F.col(f"`{c}`") for c in before.columns))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, a similarity of 0.8 or more)."""
    return minhash.drop_near_duplicates(docs, threshold_percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that have stood before out of the texts; drops documents of which nothing is left."""
    had_words = free_name(docs, "_words")
    cut = suffixes.drop_repeats(docs.withColumn(had_words, F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    left = cut.where(~F.coalesce(had_words, F.lit(False)) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _counted(docs, left)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of secrets."""
    return _counted(docs, secrets.redact_documents(docs, public_tokenizers.path(queries.SCAN_VOCABULARY)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(queries.PACK_VOCABULARY), queries.WINDOW)


#: The stages in their order; each takes (spark, docs, sf_dir) and gives a DataFrame.
STAGES = [("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("secret_scan", secret_scan), ("packing", pack)]

#: Models, suffix classes and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
