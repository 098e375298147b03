"""Tables of hard cases for the corpus operators."""

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that an operator might use for itself.
EXTRA = ["group_id", "keep", "language", "accepted", "tokens", "rate", "copies", "Key", "lam", "gone", "mark", "id", "order", "tree", "label", "h", "digest", "shard", "n", "copy", "rank", "score"]

LINE = "the quick brown fox jumps over the lazy dog near the river bank"
LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(40_000))

ROWS = [
    (1, LINE + "\n" + "another line of words that no other text of this table has", "en", "a", 10),
    (2, LINE, "en", "a", 10),
    (3, None, "en", "a", None),
    (4, "", "en", "b", 0),
    (5, " \n\t\n ", None, "b", 5),
    (6, LONG, "en", None, len(LONG)),
    (7, LONG + " tail", "en", "c", len(LONG) + 5),
    (None, LINE, "en", "a", 1),
    (8, "12345 67890 $$$ ###", "en", "a", 19),
    (9, "der schnelle braune fuchs springt heute wieder über den faulen hund am fluss", "de", "a", 5),
    (10, "der schnelle braune fuchs springt heute wieder über den faulen hund am fluss", "de", "a", 5),
    (10, "der schnelle braune fuchs springt heute wieder über den faulen hund am fluss", "de", "a", 5),
    (11, "日本語のテキスト \U0001f600 und ein wenig mehr", None, None, None),
    (None, None, None, None, None),
    (12, "x" * 50_000, "en", "c", 50_000),
]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="session")
def clashing(spark, hard):
    """The same rows with extra columns of awkward names."""
    from pyspark.sql import functions as F

    return hard.select("*", *(F.lit(f"{c}!").alias(c) for c in EXTRA), F.lit(1).alias("__gone"), F.lit(2).alias("__found"))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
