"""From raw documents to packed training sequences: five stages, each a table read by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, folder) and returns a
DataFrame, all but the last with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortry.llm import neardup, packing, pii, quality, toxicity
from cohortry.llm.common import keep, prepare, scratch, table
from cohortry.llm.queries import vocabulary
from cohortry.llm.tokens import Encoder


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without documents the classifier rejects."""
    return toxicity.keep_harmless(docs, table(prepare(spark), folder, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without documents that break a quality rule."""
    prepare(spark)
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of copies and near copies (five words, similarity 0.8)."""
    prepare(spark)
    return neardup.keep_first(docs, width=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Spans of personal data replaced by their kind."""
    prepare(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 2048 tokens."""
    prepare(spark)
    placed, _ = packing.pack_documents(docs, Encoder(vocabulary("byte_bpe_50k.json"), end=1))
    return placed.drop("uid")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: SQL has neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder."""
    at = scratch(prepare(spark), "pipeline")
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, folder), f"{at}/{name}")
    return docs
