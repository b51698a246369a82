"""Spans made from plain texts by a fixed rule, for layout queries where no positioned text is at hand.

Lines wrap at 80 characters of 6 points, 45 rows of 14 points make a page of 612 x 792 points. A first line of
under 90 characters is a title in 18 points bold. A running head with the source's name stands on every page.

typeset() says the rule in expressions and gives a row for each span. page_frames() sets whole documents where they are
read: a document's pages come of its own row, so that neither words nor pages are dealt out again (doc_id is a key).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
SPANS = (
    "doc_id long, page int, seq long, str string, size double, font string, x0 double, x1 double, y_base double, y_top double, y_bot double"
)


def words(documents: DataFrame) -> DataFrame:
    """doc_id, source, i (line), k (word), word, off (its first character's place in the line), base (rows before the line), title."""
    lines = documents.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    rows = F.greatest(F.lit(1), 1 + F.floor((F.length("line") - 1) / 80)).cast("long")
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("base", F.coalesce(F.sum(rows).over(before), F.lit(0)))
    lines = lines.withColumn("title", (F.col("i") == 0) & (F.length("line") < 90))
    pieces = lines.select("doc_id", "source", "i", "base", "title", F.posexplode(F.split("line", " ", -1)).alias("k", "word"))
    ahead = Window.partitionBy("doc_id", "i").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("off", F.coalesce(F.sum(F.length("word") + 1).over(ahead), F.lit(0)))


def typeset(documents: DataFrame, spaced: bool = True, heads: bool = True) -> DataFrame:
    """Spans of documents (doc_id, text, source). spaced: words carry the blank after them."""
    w = words(documents).filter(F.trim("word") != "")
    row = F.col("base") + F.floor(F.col("off") / 80)
    size = F.when(F.col("title"), 18.0).otherwise(12.0)
    placed = w.select(
        "doc_id", "source", F.floor(row / 45).cast("int").alias("page"), (F.col("i").cast("long") * 1_000_000 + F.col("k")).alias("seq"),
        F.concat("word", F.lit(" " if spaced else "")).alias("str"), size.alias("size"), F.when(F.col("title"), "Synth-Bold").otherwise("Synth-Roman").alias("font"),
        (72 + 6 * (F.col("off") % 80)).cast("double").alias("x0"), (72 + 6 * (F.col("off") % 80) + 6 * F.length("word")).cast("double").alias("x1"),
        (80 + 14 * (row % 45)).cast("double").alias("y_base"),
    )
    if heads:
        text = F.concat(F.coalesce("source", F.lit("")), F.lit(" page "), (F.col("page") + 1).cast("string"))
        head = placed.select("doc_id", "source", "page").distinct().select(
            "doc_id", "source", "page", F.lit(-1).cast("long").alias("seq"), text.alias("str"), F.lit(12.0).alias("size"), F.lit("Synth-Roman").alias("font"),
            F.lit(72.0).alias("x0"), (72 + 6 * F.length(text)).cast("double").alias("x1"), F.lit(40.0).alias("y_base"),
        )
        placed = placed.unionByName(head)
    return placed.select(
        "doc_id", "page", "seq", "str", "size", "font", "x0", "x1", "y_base",
        (F.col("y_base") - 0.78 * F.col("size")).alias("y_top"), (F.col("y_base") + 0.24 * F.col("size")).alias("y_bot"),
    )


#: A page's spans as arrays, in the order of seq.
ARRAYS = ("s_seq", "s_str", "s_size", "s_font", "s_x0", "s_x1", "s_y_base", "s_y_top", "s_y_bot")
#: Spans in a frame of pages, but for a single page.
FRAME_SPANS = 50_000


def set_document(text: str, source: str | None, spaced: bool = True, heads: bool = True) -> Iterator[tuple]:
    """A text's pages in order: the page's number, and an array for each of ARRAYS."""
    lines = text.split("\n")
    parted = [line.split(" ") for line in lines]
    counts = np.fromiter(map(len, parted), np.int64, len(parted))
    words = list(chain.from_iterable(parted))
    long = np.fromiter(map(len, words), np.int64, len(words))
    rows = np.maximum(1, 1 + (np.fromiter(map(len, lines), np.int64, len(lines)) - 1) // 80)
    line, first = np.repeat(np.arange(len(lines)), counts), np.cumsum(counts) - counts
    ahead = np.cumsum(long + 1) - (long + 1)
    kept = np.flatnonzero(long)
    line, long = line[kept], long[kept]
    off = ahead[kept] - ahead[first[line]]
    row = (np.cumsum(rows) - rows)[line] + off // 80
    pages = row // 45
    title = (line == 0) & (len(lines[0]) < 90)
    strings = np.empty(len(kept), object)
    strings[:] = [words[k] + " " for k in kept.tolist()] if spaced else [words[k] for k in kept.tolist()]
    x0 = (72 + 6 * (off % 80)).astype(float)
    fields = [line * 1_000_000 + kept - first[line], strings, np.where(title, 18.0, 12.0), np.where(title, "Synth-Bold", "Synth-Roman").astype(object), x0, x0 + 6 * long, (80 + 14 * (row % 45)).astype(float)]
    cuts = [0, *(np.flatnonzero(np.diff(pages)) + 1).tolist(), len(pages)] if len(pages) else [0]
    for a, b in zip(cuts, cuts[1:]):
        page, own = int(pages[a]), [f[a:b] for f in fields]
        if heads:
            head = f"{source or ''} page {page + 1}"
            own = [np.concatenate([np.array([h], f.dtype), f]) for h, f in zip((-1, head, 12.0, "Synth-Roman", 72.0, 72.0 + 6 * len(head), 40.0), own, strict=True)]
        yield page, *own, own[6] - 0.78 * own[2], own[6] + 0.24 * own[2]


def page_frames(frames: Iterator[pd.DataFrame], spaced: bool = True, heads: bool = True) -> Iterator[pd.DataFrame]:
    """Frames of documents (doc_id, text, source and anything else) as frames of their pages: doc_id, page, ARRAYS and the rest.

    These are the spans of typeset(). A null text has none. Frames are bounded by their spans.
    """
    for frame in frames:
        rest = [c for c in frame.columns if c not in ("doc_id", "text", "source")]
        columns, out, n = ["doc_id", *rest, "page", *ARRAYS], [], 0
        for doc_id, text, source, *more in zip(frame["doc_id"], frame["text"], frame["source"], *(frame[c] for c in rest)):
            if text is None:
                continue
            for page in set_document(text, source, spaced, heads):
                out.append((doc_id, *more, *page))
                n += len(page[1])
                if n >= FRAME_SPANS:
                    yield pd.DataFrame(out, columns=columns)
                    out, n = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns)


#: The same spans in SQL, as a common table expression `spans` (spaced words, running heads).
SQL = """
tl AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
tb AS (SELECT *, coalesce(sum(greatest(1, 1 + floor((length(line) - 1) / 80.0))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base, i = 0 AND length(line) < 90 AS title FROM tl),
tw AS (SELECT doc_id, source, i, base, title, generate_subscripts(string_split(line, ' '), 1) - 1 AS k, unnest(string_split(line, ' ')) AS word FROM tb),
tp AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM tw),
ts AS (SELECT doc_id, source, ((base + off // 80) // 45)::INT AS page, (i * 1000000 + k)::BIGINT AS seq, word || ' ' AS str, CASE WHEN title THEN 18.0::DOUBLE ELSE 12.0::DOUBLE END AS size,
  CASE WHEN title THEN 'Synth-Bold' ELSE 'Synth-Roman' END AS font, (72 + 6 * (off % 80))::DOUBLE AS x0, (72 + 6 * (off % 80) + 6 * length(word))::DOUBLE AS x1, (80 + 14 * ((base + off // 80) % 45))::DOUBLE AS y_base
  FROM tp WHERE trim(word, ' ') <> ''),
ta AS (SELECT * FROM ts UNION ALL SELECT DISTINCT doc_id, source, page, -1::BIGINT, source || ' page ' || (page + 1), 12.0::DOUBLE, 'Synth-Roman', 72.0::DOUBLE, (72 + 6 * length(source || ' page ' || (page + 1)))::DOUBLE, 40.0::DOUBLE FROM ts),
spans AS (SELECT doc_id, page, seq, str, size, font, x0, x1, y_base, y_base - 0.78::DOUBLE * size AS y_top, y_base + 0.24::DOUBLE * size AS y_bot FROM ta)
"""
