import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, row string, drop string, w1 string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns with names used inside."""
    words = " ".join(f"word{i}" for i in range(30))
    rows = [
        (None, "a line of at least twenty characters\nx", "en", None), (1, None, None, "s"), (2, "", "de", "s"), (3, words, "en", "s"),
        (3, words, "en", "s"), (4, words + " more", "en", "s"), (5, words.upper(), None, None), (6, "one two", "fr", "s"),
        (7, "a line of at least twenty characters\nA LINE of at least twenty characters \ny", "fr", "s"), (8, "é" * 300_000, "fr", "t"),
        (9, "a line of at least twenty characters", "en", "t"), (10, "123 !!", "en", "t"),
    ]
    return spark.createDataFrame([(*r, 1, "d", "r", "p", "w") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
