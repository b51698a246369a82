"""Text predicates and functions as column expressions.

Lengths are code points. A null text is null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import fixed as X


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Without blanks at either end, whatever kind of blank."""
    return F.regexp_replace(col(c), f"^{X.WS}+|{X.WS}+\\z", "")


def collapse(c: Column | str) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), f"{X.WS}+", " "))


def words(c: Column | str) -> Column:
    """Pieces between runs of blanks; a blank at an end leaves an empty piece there."""
    return F.split(col(c), f"{X.WS}+", -1)


def count_chars(c: Column | str, characters: str) -> Column:
    c = col(c)
    return F.length(c) - F.length(F.translate(c, characters, ""))


def count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def among(word: Column, listed: list[str]) -> Column:
    return word.isin(listed)


def is_math(c: Column | str) -> Column:
    t = col(c)
    n = F.length(t)
    density = F.when(n > 0, count_chars(t, X.MATH) / n).otherwise(0.0)
    blank, edge, no = X.WS, "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    keyword = t.rlike(f"(?i){edge}(?:arg{blank}*min|arg{blank}*max|subject to){no}|{edge}s\\.t\\.(?=[A-Za-z0-9_])")
    return F.when(n == 0, False).when(t.rlike(X.SENTENCE) & (density < 0.12), False).when((n < 90) & keyword, True).otherwise(density > 0.04)


def is_tabular(c: Column | str) -> Column:
    t = col(c)
    packed = F.replace(t, F.lit(" "), F.lit(""))
    n = F.length(packed)
    share = F.when(n > 0, count(packed, "[0-9.]") / n).otherwise(0.0)
    piece = F.transform(words(t), lambda w: F.lower(F.regexp_replace(w, r"^[.,()%:;]+|[.,()%:;]+\z", "")))
    return (
        F.when((n >= 14) & (share > 0.32), True)
        .when(F.length(t) >= 120, False)
        .when(F.size(piece) < 4, False)
        .when(t.rlike(f"[.!?:;]{X.WS}*\\z"), False)
        .otherwise(~F.exists(piece, lambda w: among(w, X.STOPWORDS)))
    )


def latin_words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(X.WORD), 0)


def looks_prose(c: Column | str) -> Column:
    w = latin_words(c)
    return (F.size(w) >= 12) & (F.size(F.filter(w, lambda x: among(x, X.STOPWORDS))) >= 3) & col(c).rlike("[.!?]")


def metrics(c: Column | str) -> dict[str, Column]:
    """n_solid, n_words, n_stops, n_ends and the shares letter, digit, math of the characters that aren't blank."""
    solid = F.regexp_replace(col(c), X.WS, "")
    n = F.greatest(F.length(solid), F.lit(1))
    w = latin_words(c)
    return {
        "n_solid": n,
        "n_words": F.size(w),
        "n_stops": F.size(F.filter(w, lambda x: among(x, X.AUDIT_STOPWORDS))),
        "letter": count(solid, "[A-Za-z]") / n,
        "digit": count(solid, "[0-9]") / n,
        "math": count_chars(solid, X.SOFT_MATH) / n,
        "n_ends": count(c, f"[.!?](?:{X.WS}|\\z)"),
    }


def is_prose(c: Column | str) -> Column:
    m = metrics(c)
    return (m["n_words"] >= 12) & (m["letter"] > 0.6) & (m["n_stops"] >= 3) & (m["math"] < 0.05) & (m["digit"] < 0.2)


def hard_math(c: Column | str) -> Column:
    return count_chars(c, X.HARD_MATH)


def norm(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def edge_key(c: Column | str) -> Column:
    """What a running head looks like on every page: numbers as #."""
    return F.substring(collapse(F.regexp_replace(col(c), "[0-9]+", "#")), 1, 60)


def is_caption(c: Column | str) -> Column:
    return col(c).rlike(X.CAPTION)


def is_bold(font: Column | str) -> Column:
    return col(font).rlike(X.BOLD)


def runaway(c: Column | str) -> Column:
    """At least 8 lines of over 4 characters, fewer than two fifths of them different."""
    lines = F.filter(F.transform(F.split(col(c), "\n", -1), trim), lambda x: F.length(x) > 4)
    return (F.size(lines) >= 8) & (F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)) < 0.4)


def pipes(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))


def shape(c: Column | str) -> Column:
    """table, math or text."""
    t = col(c)
    lines = F.split(t, r"[\n\r\x{2028}\x{2029}]", -1)
    rows = F.size(F.filter(lines, lambda x: pipes(x) >= 2))
    bare = F.exists(lines, lambda x: pipes(F.regexp_replace(x, f"^{X.WS}*{X.NOT_WS}", "")) >= 2)
    return F.when((rows >= 2) | ((rows >= 1) & bare), "table").when(t.rlike(X.FORMULA), "math").otherwise("text")


def from_otsl(c: Column | str) -> Column:
    """Table markup as lines of cells with bars between."""
    t = F.regexp_replace(col(c), "<(?:lcel|ucel|xcel)>", "<fcel>")
    t = F.regexp_replace(F.replace(t, F.lit("<nl>"), F.lit("\n")), "<(?:ched|rhed|srow)>", "")

    def row(line: Column) -> Column:
        cells = F.transform(F.split(line, X.OTSL_CELL, -1), trim)
        return trim(F.array_join(F.when(cells[0] == "", F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))).otherwise(cells), " | "))

    return F.array_join(F.filter(F.transform(F.split(t, "\n", -1), row), lambda x: x != ""), "\n")


def bound(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it, inside lambdas too."""
    return F.transform(F.array(value), body)[0]


def agreement(read: Column | str, printed: Column | str) -> dict[str, Column]:
    """cover: the share of printed's whole pieces of 24 letters and digits that read has; agrees: at least 0.6."""

    def cover_of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        n = F.floor(F.length(b) / 24).cast("int")
        pieces = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(b, i * 24 + 1, F.lit(24)))).otherwise(F.array().cast("array<string>"))
        return F.when(n > 0, F.size(F.filter(pieces, lambda p: F.contains(a, p))) / n).otherwise(0.0)

    cover = bound(F.struct(norm(read).alias("a"), norm(printed).alias("b")), cover_of)
    # a text with a whole piece has 24 letters and digits, so the least length of 20 needs no test of its own
    return {"cover": cover, "agrees": cover >= 0.6}


def split_numbered(out: Column | str, n: Column | int) -> Column:
    """The parts of a numbered answer in order, or null unless exactly 1..n are there. A repeated number's last part counts."""
    t = col(out)
    n = F.lit(n) if isinstance(n, int) else n
    ids = F.transform(F.regexp_extract_all(t, F.lit(X.MARKER), 1), lambda x: x.cast("int"))
    bodies = F.slice(F.split(t, X.MARKER, -1), 2, F.size(ids))
    last = F.transform(F.sequence(F.lit(1), n), lambda k: F.when(F.array_contains(ids, k), trim(F.element_at(bodies, (F.size(ids) - F.array_position(F.reverse(ids), k) + 1).cast("int")))))
    whole = (F.size(F.array_distinct(ids)) == n) & F.forall(last, lambda x: x.isNotNull())
    return F.when(whole, last)


def strip_markers(c: Column | str) -> Column:
    return trim(F.regexp_replace(col(c), f"<<<{X.WS}*[0-9]+{X.WS}*>>>{X.WS}*", ""))


def verdict(answer: Column | str, options: Column) -> dict[str, Column]:
    """verdict and reason of a model's answer: from its JSON object, or else the only option that it names as a word."""
    t = col(answer)
    braces = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    said = F.lower(trim(F.get_json_object(braces, "$.verdict")))
    good = F.coalesce(F.array_contains(options, said), F.lit(False))
    named = F.filter(options, lambda o: F.regexp_like(F.lower(t), F.concat(F.lit("(?<![A-Za-z0-9_])"), o, F.lit("(?![A-Za-z0-9_])"))))
    return {
        "verdict": F.when(good, said).when(F.size(named) == 1, named[0]),
        "reason": F.when(good, F.substring(F.coalesce(F.get_json_object(braces, "$.reason"), F.lit("")), 1, 40)).otherwise(""),
    }


def cache_key(model: Column, text: Column | str, language: Column | None = None) -> Column:
    """Half of a SHA-256 over model, language where given, and text, with NUL between."""
    parts = [model, *([language] if language is not None else []), col(text)]
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32)


def join_lines(lines: Column, dashes: str = "-") -> Column:
    """Lines as one text: a dash at a line's end joins the next line to it, otherwise a space does."""
    dash = "[" + "".join("\\" + d for d in dashes) + r"]\z"

    def joined(a: Column) -> Column:
        before_next = lambda x: F.when(x.rlike(dash), F.regexp_replace(x, dash, "")).otherwise(F.concat(x, F.lit(" ")))
        return F.array_join(F.transform(a, lambda x, i: F.when(i < F.size(a) - 1, before_next(x)).otherwise(x)), "")

    return collapse(bound(F.filter(lines, lambda x: x.isNotNull()), joined))


def level_by_size(size: Column | str) -> Column:
    s = col(size)
    return F.when(s >= 19, 1).when(s >= 16.5, 2).when(s >= 13.5, 3).otherwise(4)


def heading_level(text: Column | str, size: Column | str, n_lines: Column | str, body: Column | str) -> Column:
    t, s, b = col(text), col(size), col(body)
    w = F.size(words(t))
    return (
        F.when(s.isNull() | (s == 0) | (F.length(t) > 120) | (w > 18) | (col(n_lines) > 3), 0)
        .when(s >= b + 4, 1)
        .when(s >= b + 1.6, 2)
        .when((s >= b - 0.4) & t.rlike(X.NUMBERED_MODEL) & (w <= 12), 3)
        .otherwise(0)
    )


def slug(text: Column | str, number: Column | str) -> Column:
    cut = F.regexp_replace(F.substring(F.regexp_replace(trim(F.coalesce(col(text), F.lit(""))), r"[^A-Za-z0-9_\x{4E00}-\x{9FFF}.]+", "-"), 1, 36), r"^-|-\z", "")
    head = F.concat(F.lit("s"), col(number).cast("string"))
    return F.when(cut == "", head).otherwise(F.concat(head, F.lit("-"), cut))


def endpoint(url: Column | str, path: str = "/chat/completions") -> Column:
    """An API address from what a user typed; null where there is none or it isn't http."""
    u = F.regexp_replace(F.regexp_replace(trim(F.coalesce(col(url), F.lit(""))), r"/+\z", ""), r"(?i)/(chat/completions|completions|responses)\z", "")
    return F.when(u.rlike(r"(?i)^https?://"), F.concat(u, F.lit(path)))


def explain(raw: Column | str) -> Column:
    """What is wrong with an answer that isn't JSON: html, empty, or its first 200 characters."""
    head = trim(F.substring(F.coalesce(col(raw), F.lit("")), 1, 200))
    return F.when(head.rlike(r"(?i)^<(!doctype|html)"), "html").when(head == "", "empty").otherwise(head)


def number_range(c: Column | str) -> Column:
    """Two numbers from texts such as 11.4-12.6, or null."""
    found = F.filter(F.split(col(c), r"[-~,\s]+", -1), lambda x: x.rlike(r"^[0-9]*\.?[0-9]+"))
    numbers = F.transform(found, lambda x: F.regexp_extract(x, r"^[0-9]*\.?[0-9]+", 0).cast("double"))
    return F.when(F.size(numbers) == 2, numbers)


def data_url(media: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"\s", ""))


def from_data_url(url: Column | str) -> Column:
    """STRUCT<media, data> of a data URL."""
    u = col(url)
    media = F.regexp_extract(u, "data:([^;]+)", 1)
    return F.struct(F.when(media == "", "image/webp").otherwise(media).alias("media"), F.unbase64(F.regexp_extract(u, ",(.*)$", 1)).alias("data"))


def display_formula(c: Column | str) -> Column:
    """The formula of a text that is one displayed formula and nothing else, or null."""
    t = trim(c)
    square = F.regexp_extract(t, r"(?s)^\\\[(.*?)\\\]\z", 1)
    dollar = F.regexp_extract(t, r"(?s)^\$\$(.*?)\$\$\z", 1)
    return F.when(t.rlike(r"(?s)^\\\[.*?\\\]\z"), square).when(t.rlike(r"(?s)^\$\$.*?\$\$\z"), dollar)


#: The four ways of writing a formula inside a text.
INLINE = r"(?s)\\\[.*?\\\]|\$\$.*?\$\$|\\\(.*?\\\)|\$[^$\n]{1,200}?\$"


def formula_segments(c: Column | str) -> Column:
    """ARRAY<STRUCT<kind, source>>: text and formulas of a text in order; sources joined give the text. A blank formula is text."""
    t = col(c)
    inner = lambda m: F.regexp_replace(m, r"^(\\[\[(]|\$\$?)|(\\[\])]|\$\$?)\z", "")
    # both arrays are bound to a variable, or they would be made again for each piece
    both = F.array(F.struct(F.regexp_extract_all(t, F.lit(INLINE), 0).alias("formulas"), F.split(t, INLINE, -1).alias("between")))

    def pieces(x: Column) -> Column:
        formula = lambda i: F.coalesce(F.get(x["formulas"], i), F.lit(""))
        pairs = F.transform(
            x["between"],
            lambda b, i: F.array(F.struct(F.lit("text").alias("kind"), b.alias("source")), F.struct(F.when(trim(inner(formula(i))) == "", "text").otherwise("formula").alias("kind"), formula(i).alias("source"))),
        )
        return F.filter(F.flatten(pairs), lambda s: s["source"] != "")

    return F.when(t.isNotNull(), F.transform(both, pieces)[0])
