"""The queries of the training-data operators, one for each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ridgewatch.llm import (
    bpe, byte_grams, chat, decontaminate, license_scan, ngram_join, pii, quality_model, quality_rules, secrets, token_output,
)
from ridgewatch.llm.common import table
from ridgewatch.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

RANKS = "byte_bpe_50k.tiktoken"
#: The key of the training order.
ORDER_KEY = 20_240_229


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.materialised(
        table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, key=ORDER_KEY
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true links of each document, counted; op3_ngram_join has its SQL twin's columns."""
    return ngram_join.link_counts(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = public_tokenizers.path(RANKS)
    out = chat.read_back(chat.assemble(rows, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    return out.drop("n_tokens")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf_dir, "documents"))
    return decontaminate.report(index, table(spark, sf_dir, "benchmark")).drop("text_key", "n_near", "items", "near_items")


def op7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the items that each document has exactly and nearly; op7_decontamination has its SQL twin's columns."""
    index = decontaminate.build_index(table(spark, sf_dir, "documents"))
    found = decontaminate.report(index, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "contaminated", "items", "near_items")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"), byte_grams.METHOD)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(license_scan.document_paths(table(spark, sf_dir, "documents")), key="doc_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_pii": op2_pii,
    "op3_ngram_join": op3_ngram_join,
    "op3_links": op3_links,
    "op4_chat_format": op4_chat_format,
    "op5_token_output": op5_token_output,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_decontamination": op7_decontamination,
    "op7_proximity": op7_proximity,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scan": op9_license_scan,
    "op10_quality_classifier": op10_quality_classifier,
}
