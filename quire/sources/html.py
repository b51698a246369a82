"""Blocks of web pages: comments, scripts and styles go first by an expression, then a fold takes a page's elements in order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

NOISE = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"

_TAG = re.compile(r"<(/?)([a-z]\w*)\b[^>]*>|<[!?][^>]*>", re.I | re.A)
_HEADINGS = {f"h{i}" for i in range(1, 7)}
_TEXTS = _HEADINGS | {"p", "li", "figcaption", "td"}
_TABLE = {"table", "thead", "tbody", "tfoot", "tr", "th", "caption"}
_BLOCKS = _TEXTS | _TABLE | {"html", "head", "body", "title", "div", "article", "section", "main", "nav", "aside", "header", "footer", "figure", "blockquote", "pre", "address", "ul", "ol", "menu", "dl", "dt", "dd", "form", "fieldset", "details", "summary"}
_BREAKS = {"br", "hr"}
#: What a start tag ends where an end tag was left out, and the blocks beyond which it ends nothing.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "td": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"})}
_ENDS |= {"dd": _ENDS["dt"], "th": _ENDS["td"]} | {t: ({"thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")} | {h: (_HEADINGS, _BLOCKS - _HEADINGS) for h in _HEADINGS}
_CELLS = {"table", "td", "th"}


def plain(html: Column | str) -> Column:
    return F.regexp_replace(T.col(html), NOISE, "")


def elements(html: str) -> list[tuple[str, str]]:
    """(tag, text) of a page's elements, in the order of their start tags.

    A text belongs to the innermost open element, so none counts twice. Inner tags are left out; a block or a line break
    inside an element is a space. An element without an end tag goes to the next block that can't be inside it, or to the
    end of what it is in. An image has no inside: a text after it is its own only where no element is open.
    """
    found: list[tuple[str, list[str]]] = []
    stack: list[tuple[str, list[str] | None]] = []  # open blocks; the parts of the element that their texts go to
    loose: list[str] | None = None

    def end(names: set[str], bounds: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in bounds:
                return

    def say(text: str) -> None:
        into = stack[-1][1] if stack else None
        if into is None:
            into = loose
        if into is not None:
            into.append(text)

    at = 0
    for m in _TAG.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if name in _BREAKS:
            say(" ")
        elif name == "img" and not m[1]:
            found.append((name, []))
            if not stack or stack[-1][1] is None:
                loose = found[-1][1]
        elif name in _BLOCKS:
            loose = None
            say(" ")
            if m[1]:
                end({name}, set() if name in _CELLS or name in _TABLE else _CELLS)
            else:
                end({"p"}, _CELLS)
                if name in _ENDS:
                    end(*_ENDS[name])
                into = stack[-1][1] if stack else None
                if name in _TEXTS:
                    found.append((name, into := []))
                stack.append((name, into))
            say(" ")
    say(html[at:])
    return [(tag, "".join(parts)) for tag, parts in found]


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, seq, tag, kind, level, text of pages (page_id, html). An element has its whole text, see `elements`."""
    clean = pages.select("page_id", plain("html").alias("html"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i, tag, text) for p, html in zip(frame["page_id"], frame["html"], strict=True) for i, (tag, text) in enumerate(elements(html or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "seq", "tag", "text"])

    rows = clean.mapInPandas(run, f"page_id {clean.schema['page_id'].dataType.simpleString()}, seq int, tag string, text string").withColumn("text", T.collapse("text"))
    kind = F.when(F.col("tag").rlike("^h[1-6]$"), "heading").when(F.col("tag") == "img", "graphic").when(F.col("tag") == "figcaption", "caption").otherwise("para")
    level = F.when(kind == "heading", F.substring("tag", 2, 1).cast("int"))
    return rows.select("page_id", "seq", "tag", kind.alias("kind"), level.alias("level"), "text")


def census(pages: DataFrame, many: int = 40) -> DataFrame:
    """How many text elements, drawn elements and images a page has, and whether it likely has figures."""
    clean = pages.select("page_id", plain("html").alias("html"))
    n = lambda p: F.regexp_count("html", F.lit(p))
    texts, drawn, images = n(r"(?i)<(?:h[1-6]|p|li|td)\b"), n(r"(?i)<(?:svg|path|rect|line|div|span)\b"), n(r"(?i)<img\b")
    return clean.select("page_id", texts.alias("texts"), drawn.alias("drawn"), images.alias("images"), ((images > 0) | (drawn > many)).alias("likely_figures"))
