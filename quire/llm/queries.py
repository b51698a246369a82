"""The queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, chat, exact_dedup, mixing, near_dedup, quality, token_store, topk, toxicity, warc
from quire.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.digest(table(spark, sf_dir, "embeddings"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_warc": op2_warc,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_token_store": op8_token_store,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_chat": op10_chat,
}
ORACLES: dict[str, str] = {
    "op1_topk": topk.ORACLE,
    "op2_warc": warc.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
}
