"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortry.llm import ann, fingerprints, licenses, merkle, neardup, packing, pieces, pii, quality, rans, search, toxicity, warc
from cohortry.llm.oracles import ORACLES  # noqa: F401
from cohortry.llm.common import prepare, scratch, table
from cohortry.llm.tokens import Encoder


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is: in ``$TOKENIZER_DIR``, or where the installed package says."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(prepare(spark), folder, "documents"))
    return judged.drop("lang", "source", "n_lines", "n_upper", "n_bangs")


def op2_rans_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(prepare(spark), folder, "documents")
    at = scratch(spark, "rans")
    rans.store_ids(docs, Encoder(vocabulary("word_bpe_49k.json"), end=2), at)
    return rans.load_ids(spark, at).drop("ids")


def op3_ffd_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(prepare(spark), folder, "documents")
    placed, _ = packing.pack_documents(docs, Encoder(vocabulary("byte_bpe_50k.json"), end=1))
    return placed.drop("uid")


def op4_bottom_k_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(prepare(spark), folder, "documents"), width=3, percent=85)


def op5_vantage_point_trees(spark: SparkSession, folder: str) -> DataFrame:
    vectors = ann.usable(table(prepare(spark), folder, "embeddings"))
    return ann.nearest(ann.every_twentieth(vectors), vectors, k=20)


def op6_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch(prepare(spark), "warc")
    warc.write_archives(table(spark, folder, "pages"), at)
    return warc.read_archives(spark, at).drop("url", "html")


def op7_pii_spans(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(prepare(spark), folder, "documents"))


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(prepare(spark), folder, "documents")
    return pieces.encode_documents(docs, pieces.PieceModel(vocabulary("piece_bpe_32k.model"))).drop("ids")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(prepare(spark), folder, "documents"), table(spark, folder, "labels"))


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.find_licenses(table(prepare(spark), folder, "documents"))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search_documents(table(prepare(spark), folder, "documents"), table(spark, folder, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.prove(table(prepare(spark), folder, "documents"))


def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(prepare(spark), folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_rans_tokens, op3_ffd_packing, op4_bottom_k_duplicates, op5_vantage_point_trees,
        op6_warc_revisits, op7_pii_spans, op8_sentencepiece, op9_toxicity, op10_license_scan,
        op11_ranked_search, op12_merkle_manifest, op13_fingerprints, pipeline,
    )
}
