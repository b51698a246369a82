"""Golden values of the text functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quire.functions import fixed as X
from quire.functions import text as T


def value(spark, expression, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(expression.alias("v")).first()["v"]


CASES = [
    (T.is_caption, {"Figure1. x": True, "Fig. 2": True, "Table A.1": True, "Panel A1": True, "Exhibit": False, "Panel B": False}),
    (lambda c: c.rlike(X.PAGE_NUMBER), {"xiv": True, "12": True, "": True, "Civil1": True, "page": False}),
    (lambda c: c.rlike(X.NUMBERED), {"2 Context": True, "2.1 Asset": True, "A.1 Proof": True, "2. Context": False, "3x": False}),
    (lambda c: c.rlike(X.NUMBERED_MODEL), {"2 Context": True, "2. Context": True, "3x": True, "x3": False}),
    (T.is_tabular, {"500–506.": False, "0.2880.4130.8991.057": True, "Firm Size Return Volatility": True, "mean of the sample here": False, "Model AUC F1": False}),
    (T.is_math, {"": False, "∑x∈S": True, "The sum ∑ is ∑ taken over all x": False, "choose arg min of f": True, "plain words": False}),
    (T.edge_key, {"  NVIDIA   12  ": "NVIDIA #", "p. 3 of 44": "p. # of #"}),
    (T.shape, {"a | b | c\nd | e | f": "table", "a | b | c": "table", "\\frac{1}{2}": "math", "plain": "text", "a | b": "text"}),
    (T.from_otsl, {"<fcel>a<fcel>b<nl><fcel>c<lcel><nl>": "a | b\nc |", "": ""}),
    (T.runaway, {"\n".join(["aaaaa"] * 8): True, "\n".join(["aaaaa"] * 7): False, "\n".join(f"line {i}" for i in range(9)): False}),
    (T.endpoint, {"https://h/v1/": "https://h/v1/chat/completions", "https://h/v1/chat/completions/": "https://h/v1/chat/completions", "ftp://h": None, "": None}),
    (T.explain, {" <!DOCTYPE html>": "html", "": "empty", '{"a": 1}': '{"a": 1}'}),
    (T.number_range, {"11.4-12.6": [11.4, 12.6], "11 , 12": [11.0, 12.0], "11": None, "a-b": None}),
    (T.display_formula, {" \\[ x \\] ": " x ", "$$y$$": "y", "a $$y$$": None}),
    (T.strip_markers, {"<<< 1 >>>\n a ": "a", "b": "b"}),
    (lambda c: T.slug(c, F.lit(3)), {" 1. Intro — x": "s3-1.-Intro-x", "": "s3", "??": "s3"}),
    (T.looks_prose, {"we show that the model of the market is not in its own way a good one.": True, "too short.": False}),
]


@pytest.mark.parametrize(("function", "golden"), CASES)
def test_goldens(spark, function, golden):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(golden)], "i int, t string")
    got = [r["v"] for r in rows.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]
    assert dict(zip(golden, got, strict=True)) == golden


def test_levels(spark):
    rows = spark.createDataFrame([(19.0,), (16.5,), (13.5,), (12.0,)], "s double")
    assert [r[0] for r in rows.select(T.level_by_size("s")).collect()] == [1, 2, 3, 4]
    level = lambda t, s, n=1: value(spark, T.heading_level("t", "s", F.lit(n), F.lit(12.0)), t=t, s=s)
    assert [level("Title", 16.0), level("Title", 13.6), level("3.1 Latent structure", 12.0), level("Plain", 12.0), level("Title", 16.0, 4), level("w " * 20, 16.0)] == [1, 2, 3, 0, 0, 0]


def test_agreement(spark):
    def of(a, b):
        return tuple(spark.createDataFrame([(a, b)], "a string, b string").select(*T.agreement("a", "b").values()).first())

    letters = hashlib.sha256(b"a").hexdigest() + hashlib.sha256(b"b").hexdigest()
    assert of("x", "a" * 19) == (0.0, False) and of("a" * 22, "a" * 22) == (0.0, False)
    assert of(letters, letters) == (1.0, True) and of(letters[:50], letters)[1] is False


def test_numbered_answers(spark):
    split = lambda t, n: value(spark, T.split_numbered("t", n), t=t)
    assert split("<<<1>>>\na\n<<<2>>>\nb", 2) == ["a", "b"] and split("<<<1>>>\na", 2) is None
    assert split("<<<2>>>\nb\n<<<1>>>\na\n<<<2>>> \nc", 2) == ["a", "c"] and split("<<<1>>>\na\n<<<3>>>\nb", 2) is None


def test_verdicts(spark):
    options = F.array(F.lit("one"), F.lit("two"))
    said = lambda t: value(spark, F.struct(*[v.alias(k) for k, v in T.verdict("t", options).items()]), t=t)
    assert tuple(said('ok {"verdict":"ONE","reason":"r"}')) == ("one", "r") and said("one or two")["verdict"] is None
    assert said("it is two")["verdict"] == "two" and said("twofold")["verdict"] is None and said('{"verdict": broken two')["verdict"] == "two"


def test_joined_lines(spark):
    rows = spark.createDataFrame([(["a hy-", "phen", "", "end  x"],)], "l array<string>")
    assert rows.select(T.join_lines(F.col("l"))).first()[0] == "a hyphen end x"


def test_formula_segments(spark):
    rows = value(spark, T.formula_segments("t"), t="a \\(x\\) b $$y$$$ $ c \\[z\\]")
    assert "".join(r["source"] for r in rows) == "a \\(x\\) b $$y$$$ $ c \\[z\\]"
    assert [(r["kind"], r["source"]) for r in rows][:4] == [("text", "a "), ("formula", "\\(x\\)"), ("text", " b "), ("formula", "$$y$$")]
    assert ("text", "$ $") in [(r["kind"], r["source"]) for r in rows]  # a blank formula is text


def test_keys_and_bytes(spark):
    assert value(spark, T.cache_key(F.lit("m"), "t"), t="x") == hashlib.sha256(b"m\0x").hexdigest()[:32]
    assert value(spark, T.cache_key(F.lit("m"), "t", F.lit("fr")), t="x") != value(spark, T.cache_key(F.lit("m"), "t", F.lit("de")), t="x")
    long = "é" * 500
    back = value(spark, T.from_data_url(T.data_url(F.lit("image/png"), F.encode("t", "UTF-8"))), t=long)
    assert back["media"] == "image/png" and bytes(back["data"]) == long.encode()


def test_fixed_values():
    assert len(X.MATH) == 48 and len(X.STOPWORDS) == 33 and len(X.AUDIT_STOPWORDS) == 47 and len(X.GLOSSARY) == 67
