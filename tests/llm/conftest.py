import pytest

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", None),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, "der schnelle braune Fuchs springt über den faulen Hund und schläft dann ein", "de", "a"),
    (5, "der schnelle braune Fuchs springt über den faulen Hund und schläft dann ein", "de", "a"),
    (6, " \n\t ", "de", "a"),
    (7, "mail bob@example.com or call +1 555 123-4567, under the MIT License! " * 3, "en", None),
    (None, "no id at all but some words 😀", None, "c"),
    (9, "x" * 5000 + " " + "word " * 3000, "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, texts and languages, empty and very long texts, repeated rows, and columns named like results."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return docs.withColumns({"n_chars": F.char_length("text").cast("long"), "size": F.lit("clash"), "score": F.lit("clash"), "node": F.lit("clash")})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
