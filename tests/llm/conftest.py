import pytest


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = "word token " * 20_000
    rows = [
        (1, None, "en", "a", None, 1, "t"),
        (2, "", None, None, 0, 2, "t"),
        (None, "no id here", "en", "a", 10, 3, "t"),
        (4, long, "en", "b", len(long), None, None),
        (5, "same text twice", "en", "b", 15, 5, "t"),
        (5, "same text twice", "en", "b", 15, 5, "t"),
        (6, "same text twice", "de", None, 15, 6, "t"),
        (7, " \t\n", "de", "a", 3, 7, "t"),
        (8, "é漢字😀 \x00 password: hunter2hunter2", "fr", "a", 33, 8, "t"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, i long, t string")


@pytest.fixture(scope="session")
def docs(spark):
    from tests.conftest import DATA

    return spark.read.parquet(f"{DATA}/documents.parquet")
