import pytest

LONG = "word " * 60_000 + "end"


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and further columns whose names clash with those of results and inputs."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "a", "en", "x", 1),
        (1, "the quick brown fox jumps over the lazy dog again and again", "a", "en", "x", 1),
        (2, "The Quick brown fox jumps over the lazy dog again and again", "a", "en", "y", 2),
        (3, None, None, None, None, None),
        (None, None, None, None, None, None),
        (None, "text without an id, of enough words to be kept by rules", "b", None, None, None),
        (4, "", "b", "en", None, 3),
        (5, " \t\n ", "b", "en", None, 3),
        (6, LONG, "b", "en", None, 3),
        (7, "the  quick brown fox jumps over the lazy dog again and again ", "a", "en", "x", 1),
        (8, "one two", "c", "fr", "x", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, Kept string, row int")
    return df.toDF("doc_id", "text", "source", "lang", "Text", "DOC_ID")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, kept string")
