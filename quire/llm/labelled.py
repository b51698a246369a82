"""Bounded samples of labelled documents, for the classifiers to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import held_out

#: A text beyond this many bytes is not learned from (it is scored like any other).
LONGEST = 1 << 16
#: Bytes of all texts learned from, at most; those beyond, in the sample's order, are left out.
IN_ALL = 16 << 20
#: Labels looked up among the documents, as a multiple of the sample: those without a document take no place in it.
POOL = 2


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_positive: int | None = None) -> list[tuple[str, int]]:
    """(text, label) of at most so many documents whose ids are not held out, the same ones each time.

    Documents are taken in the order of a hash of their id. A document labelled twice counts with its least label; of rows
    that share an id, the one whose text has the least hash. The driver gets `most` rows, and keeps IN_ALL bytes of them.
    """
    picked = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if most_positive is not None:
        picked = picked.filter("label = 1").orderBy(*order).limit(POOL * most_positive).unionByName(picked.filter("label = 0").orderBy(*order).limit(POOL * (most - most_positive)))
    else:
        picked = picked.orderBy(*order).limit(POOL * most)
    texts = docs.select(F.col("doc_id").alias("_id"), "text").filter(F.octet_length("text") <= LONGEST)
    rows = texts.join(F.broadcast(picked), F.col("_id") == F.col("doc_id"))  # at most POOL * most pairs of numbers are broadcast
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    if most_positive is not None:
        place = F.row_number().over(Window.partitionBy("label").orderBy(*order))
        rows = rows.withColumn("place", place).filter(F.col("place") <= F.when(F.col("label") == 1, most_positive).otherwise(most - most_positive))
    else:
        rows = rows.orderBy(*order).limit(most)
    found = rows.select(F.xxhash64("doc_id").alias("at"), "doc_id", "text", "label").collect()
    kept, room = [], IN_ALL
    for _, doc_id, text, y in sorted(map(tuple, found)):
        room -= len(text.encode())
        if room < 0:
            break
        kept.append((doc_id, text, y))
    return [(text, y) for _, text, y in sorted(kept)]
