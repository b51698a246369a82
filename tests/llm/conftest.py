import pytest

#: Columns beside those of documents, named like the operators' own.
CLASHING = "size long, target double, copies long, d long, u long, uid long, id long, k int, n long, bytes string, score double, keep_id long, family long, _d long, _copy int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties and repeated rows, and clashing columns."""
    body = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    long = " ".join(f"word{i % 977} and{i}" for i in range(40_000))
    rows = [
        (1, body, "en", "a"), (2, body, "en", "a"), (2, body, "en", "a"), (3, body.upper(), "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, "   \n\t ", None, "b"),
        (7, long, "en", "c"), (8, long + " tail", "en", "c"), (None, body, "en", None), (None, None, None, None), (9, "short text", "en", "b"), (10, "Short Text", "en", "b"),
        (11, "ünïcode 文字 🎉 <|endoftext|> \\x", "fr", "a"), (12, "a | b | c\n" * 50, "en", "c"), (2, "another text of the same id", "en", "a"),
    ]
    clash = [None] * len(CLASHING.split(", "))
    return spark.createDataFrame([(*r, 0, *clash) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (None, 1, 1), (5, None, None), (6, 0, 0), (7, 1, 0), (99, 1, 1), (12, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture
def none(odd):
    return odd.limit(0)
