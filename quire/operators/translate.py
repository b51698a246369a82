"""Translation: cache lookup, packing into batches, the numbered protocol, calls and write-back."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed as X
from quire.functions import text as T
from quire.operators import packing

#: A client takes the system's and the user's part and returns the answer. It must be picklable; it runs on executors.
Client = Callable[[str, str], str]


@dataclass(frozen=True)
class Settings:
    """How translation runs. Unknown or malformed saved values leave the defaults."""

    model: str = "offline"
    language: str = "zh-Hans"
    batch_chars: int = 2200
    max_tokens: int = 8000
    concurrency: int = 6
    retry: int = 3
    pause: float = 1.2

    def overlaid(self, saved: dict | None) -> Settings:
        own = {k: type(v) for k, v in vars(self).items()}
        good = {k: v for k, v in (saved or {}).items() if k in own and isinstance(v, own[k])}
        return Settings(**{**vars(self), **good})


def pending(blocks: DataFrame) -> DataFrame:
    """Blocks of translated kinds with text and no translation yet."""
    return blocks.filter(F.col("kind").isin(*X.TRANSLATED_KINDS) & (T.trim(F.coalesce("text", F.lit(""))) != "") & (F.coalesce("zh", F.lit("")) == ""))


def looked_up(blocks: DataFrame, cache: DataFrame, model: str, language: str | None = None) -> DataFrame:
    """blocks with k, their cache key, and zh filled from the cache (k, zh)."""
    key = T.cache_key(F.lit(model), "text", F.lit(language) if language else None)
    known = cache.select(F.col("k"), F.col("zh").alias("_zh"))
    return blocks.withColumn("k", key).join(known, "k", "left").withColumn("zh", F.coalesce("zh", "_zh")).drop("_zh")


def packed(blocks: DataFrame, by: list[str], order: str, limit: int, size: Column | None = None) -> DataFrame:
    """blocks with `batch`: consecutive blocks until the next would make it longer than limit; a longer one is alone.

    Lengths alone are packed (operators.packing); texts stay where they are and are joined by key.
    """
    keys = [*by, order]
    length = F.length("text") if size is None else size
    found = packing.packed(blocks.select(*keys, length.alias("_length")), by, order, "_length", limit)
    found = found.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keys)], "batch")
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(keys)]
    return blocks.join(found, same).select(*keys, *[c for c in blocks.columns if c not in keys], "batch")


def glossary_hits(batches: DataFrame, keys: list[str], texts: Column, most: int = 40) -> DataFrame:
    """keys, terms: the first terms of the glossary, in its order, that a batch's texts hold. The glossary is a constant of the plan."""
    terms = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(f"{k} → {v}").alias("t")) for k, v in X.GLOSSARY.items()])
    found = T.bound(F.lower(texts), lambda blob: F.filter(terms, lambda t: F.contains(blob, t["k"])))
    return batches.select(*keys, F.transform(F.slice(found, 1, most), lambda t: t["t"]).alias("terms"))


#: What a model is told: the language, what stays as it is, the markers; and the terms to use, where there are any.
RULES = "Translate English academic text into {language}. Keep names, citations, symbols and equation numbers. Add nothing. Answer each <<<number>>> part under its own marker."
TERMS = "\nUse these terms:\n"


def system_prompt(language: str, terms: Column | str) -> Column:
    """The system's part for a batch with these terms (ARRAY<STRING>)."""
    listed = F.col(terms) if isinstance(terms, str) else terms
    return F.concat(F.lit(RULES.replace("{language}", language)), F.when(F.size(listed) > 0, F.concat(F.lit(TERMS), F.array_join(listed, "；"))).otherwise(""))


def numbered(texts: list[str]) -> str:
    return "\n".join(f"<<<{i}>>>\n{t}" for i, t in enumerate(texts, 1))


def token_budget(chars: Column, most: int) -> Column:
    return F.least(F.lit(most), (F.floor(chars * 1.6 + 0.5) + 2000).cast("int"))


def ask(client: Client, system: str, user: str, tries: int, pause: float) -> str:
    """The client's answer; after a failure a pause that grows, and another try."""
    for attempt in range(1, tries + 1):
        try:
            return client(system, user)
        except Exception:
            if attempt == tries:
                raise
            time.sleep(pause * attempt)
    raise ValueError("no try was allowed")


def parts_of(answer: str, n: int) -> list[str] | None:
    import re

    cut = re.split(r"(?m)^<<<(\d+)>>>[ \t]*$", answer)
    found = {int(k): v.strip() for k, v in zip(cut[1::2], cut[2::2], strict=True)}
    return [found[k] for k in range(1, n + 1)] if found.keys() == set(range(1, n + 1)) else None


def translated_batches(batches: DataFrame, client: Client, settings: Settings) -> DataFrame:
    """batches (batch_id, items: ARRAY<STRUCT<id, text>>, system) to id, zh, err.

    Each batch is a row. A task makes `concurrency` calls at a time, so the cluster's limit is that by its cores; partitions
    stay as many as the session has. A batch of one is sent as it is; where a numbered answer doesn't fit, its texts are sent one by one; a batch that fails leaves empty translations with the error.
    """
    import re

    def clean(text: str) -> str:
        return re.sub(r"<<<\s*\d+\s*>>>\s*", "", text).strip()

    def of_batch(items, system: str) -> list[tuple]:
        ids, texts = [i["id"] for i in items], [i["text"] for i in items]
        call = lambda user: ask(client, system, user, settings.retry, settings.pause)
        try:
            got = [call(texts[0])] if len(texts) == 1 else parts_of(call(numbered(texts)), len(texts)) or [call(t) for t in texts]
            return [(i, clean(z), None) for i, z in zip(ids, got, strict=True)]
        except Exception as e:  # recorded with the blocks, which stay pending
            return [(i, "", str(e)[:120]) for i in ids]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            with ThreadPoolExecutor(settings.concurrency) as pool:
                out = [row for rows in pool.map(of_batch, frame["items"], frame["system"]) for row in rows]
            yield pd.DataFrame(out, columns=["id", "zh", "err"])

    ids = batches.schema["items"].dataType.elementType["id"].dataType.simpleString()
    return batches.repartition("batch_id").mapInPandas(run, f"id {ids}, zh string, err string")


def translate(blocks: DataFrame, cache: DataFrame, client: Client, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """blocks (doc_id, block_id, kind, text, zh) with zh and err filled in, and the new cache rows (k, zh).

    A block's id across documents is the pair of both.
    """
    known = looked_up(blocks, cache, settings.model, settings.language)
    todo = pending(known)
    batch = packed(todo.select("doc_id", "block_id", "text"), ["doc_id"], "block_id", settings.batch_chars)
    whole = F.array_sort(F.collect_list(F.struct(F.struct("doc_id", "block_id").alias("id"), "text")))
    rows = batch.groupBy("doc_id", "batch").agg(whole.alias("items"))
    rows = rows.withColumn("batch_id", F.xxhash64("doc_id", "batch"))
    terms = glossary_hits(rows, ["batch_id"], F.array_join(F.transform("items", lambda i: i["text"]), " "))
    done = translated_batches(rows.join(terms, "batch_id").select("batch_id", "items", system_prompt(settings.language, "terms").alias("system")), client, settings).withColumnRenamed("zh", "_zh")
    done = done.select(F.col("id.doc_id").alias("_doc"), F.col("id.block_id").alias("_block"), "_zh", "err")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("block_id").eqNullSafe(F.col("_block"))
    out = known.join(done, same, "left").withColumn("zh", F.coalesce(F.when(F.col("zh") != "", F.col("zh")), "_zh", "zh")).drop("_doc", "_block", "_zh")
    fresh = out.filter(F.col("err").isNull() & (F.coalesce("zh", F.lit("")) != "")).select("k", "zh").join(cache.select("k"), "k", "left_anti").dropDuplicates(["k"])
    return out, fresh


def offline_client(system: str, user: str) -> str:
    """A client without a model: every e is made an E, markers are kept. For tests and dry runs."""
    return "\n".join(line if line.startswith("<<<") else line.replace("e", "E") for line in user.split("\n"))
