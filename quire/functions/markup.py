"""Small markdown to HTML as column expressions; formulas kept apart so that no rule changes them.

A text is split into lines, each of which gets a kind (heading, item of either list, paragraph, blank) from the table of
line patterns; a line's HTML opens and closes a list where its kind differs from its neighbour's. Marks within a line are
replaced by the table of inline patterns. A formula is taken out first and leaves a mark that no text can hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.fixed import FORMULA_IN_TEXT, INLINE_MARKS, LINE_MARKS, WS
from quire.functions.text import col

#: What a formula leaves; the first of the two stands in no text without the third behind it.
_LEAD, _HERE, _OWN = "\ue000", "\ue001", "\ue002"


def _escaped(c: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), c)


def _formula(c: Column) -> Column:
    """A formula's HTML: its source between the marks for shown or running ones."""
    double = c.startswith("$$") | c.startswith("\\")
    body = _escaped(F.when(double, F.substr(c, F.lit(3), F.length(c) - 4)).otherwise(F.substr(c, F.lit(2), F.length(c) - 2)))
    mark = F.when(c.startswith("$$") | c.startswith("\\["), "$$").otherwise("$")
    return F.concat(mark, body, mark)


def _inline(c: Column) -> Column:
    return reduce(lambda x, pair: F.regexp_replace(x, pair[0], pair[1]), INLINE_MARKS, _escaped(c))


def _classified(line: Column) -> Column:
    """kind and body of a line without blanks at its end."""
    out = F.when(line == "", F.struct(F.lit("").alias("kind"), line.alias("body")))
    for kind, mark in LINE_MARKS:
        out = out.when(line.rlike(f"^{mark}"), F.struct(F.lit(kind).alias("kind"), F.regexp_replace(line, f"^{mark}", "").alias("body")))
    return out.otherwise(F.struct(F.lit("p").alias("kind"), line.alias("body")))


def _tag(kind: Column, closing: bool) -> Column:
    return F.when(kind.isin("ul", "ol"), F.concat(F.lit("</" if closing else "<"), kind, F.lit(">"))).otherwise("")


def markdown_html(c: Column | str) -> Column:
    """Headings, lists, paragraphs, code, strong and emphasis; formulas with their source. Null gives null."""
    source = F.replace(col(c), F.lit(_LEAD), F.lit(_LEAD + _OWN))
    formulas = F.transform(F.regexp_extract_all(source, F.lit(FORMULA_IN_TEXT), F.lit(0)), _formula)
    lines = F.split(F.regexp_replace(source, FORMULA_IN_TEXT, _LEAD + _HERE), "\n", -1)
    told = F.transform(lines, lambda x: _classified(F.regexp_replace(x, f"{WS}+\\z", "")))

    def shown(rows: Column) -> Column:
        def html(row: Column, i: Column) -> Column:
            kind, before = row["kind"], F.coalesce(F.get(rows, i - 1)["kind"], F.lit(""))
            turn = F.when(kind == before, "").otherwise(F.concat(_tag(before, True), _tag(kind, False)))
            name = F.when(kind.isin("ul", "ol"), "li").when(kind == "h", "h3").otherwise("p")
            return F.concat(turn, F.when(kind == "", "").otherwise(F.concat(F.lit("<"), name, F.lit(">"), _inline(row["body"]), F.lit("</"), name, F.lit(">"))))

        return F.concat(F.array_join(F.transform(rows, html), ""), _tag(F.element_at(rows, -1)["kind"], True))

    whole = F.transform(F.array(F.struct(told.alias("rows"), formulas.alias("formulas"))), lambda x: F.struct(F.split(shown(x["rows"]), _LEAD + _HERE, -1).alias("parts"), x["formulas"].alias("formulas")))[0]
    filled = F.transform(F.array(whole), lambda x: F.array_join(F.transform(x["parts"], lambda part, i: F.concat(part, F.coalesce(F.get(x["formulas"], i), F.lit("")))), ""))[0]
    return F.replace(filled, F.lit(_LEAD + _OWN), F.lit(_LEAD))
