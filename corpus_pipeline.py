"""The corpus pipeline: quality, exact copies, near copies, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents, whatever else docs has beside
doc_id, text and source; further columns go through unread.

Defined results
---------------
* A null text is an empty one for every stage; a null doc_id or source is a value like any other.
* Repeated rows: the quality stage judges each; of rows of equal text the copies' stage keeps one.
* A tie of equal scores does not arise: a document stays if its own score reaches the threshold.
* No documents give no rows at every stage; without labels of both kinds the quality stage keeps all or none,
  by the share of label 1.
* Texts of any length are read whole; memory is bounded by the longest text's own size.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, exact_dedup, mixing, near_dedup, quality
from quire.llm.common import settle, table
from quire.llm.labelled import sample

TOKENIZER = "byte_bpe_50k.json"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (op 4). It learns from the labels of sf_dir."""
    model = quality.learn(sample(docs, table(spark, sf_dir, "labels"), "quality", quality.SAMPLE))
    return quality.keep(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id (op 9)."""
    return exact_dedup.kept_rows(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group, linked from a similarity of 0.8, the document with the smallest id (op 3)."""
    return near_dedup.kept_rows(docs, near_dedup.NEAR)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights (op 5); a document taken twice gives two rows."""
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's tokens, and what they decode to, as digests (op 7)."""
    return bpe.digest(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: SQL can express neither the classifier nor the links of near copies; tests/llm/test_pipeline.py holds run() against plain steps.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
