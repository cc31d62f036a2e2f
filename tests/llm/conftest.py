import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score string, kept string, n_tokens string, component_id string, mix string, shards string"


def frame(spark, rows):
    """documents with columns whose names operators use too."""
    return spark.createDataFrame([(*r, r[0], "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and equal texts."""
    long = "word " * 30_000 + "a" * 50_000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. " * 4, "en", "a", 1), (2, "", "en", "a", 0), (3, None, None, None, None), (4, long, "en", "b", 1), (5, "  \n\t ", "de", "b", 5),
        (6, "The quick brown fox jumps over the lazy dog. " * 4, "en", None, 1), (7, "x", "fr", "c", 1), (7, "x", "fr", "c", 1), (None, "no id here, only a few words", "en", "a", 2), (8, "ça été 1½ \U0001f600 <|endoftext|> end", "fr", "c", 3),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
