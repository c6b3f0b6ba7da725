import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text[, lang, source]) tuples."""

    def run(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return run


LONG = "word" * 3000 + " " + "alpha beta gamma " * 4000


@pytest.fixture
def odd(make):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows,
    and extra columns whose names clash with those operators make."""
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, LONG), (5, LONG), (None, "a b c"), (6, "A b C"), (7, "a B c", None, None), (None, None, None, None), (8, "token = abcdef123456 é ▁ <|endoftext|>")]
    docs = make(*rows)
    for name in ("kept", "size", "chunk", "digest", "fp", "weight", "copies", "winner", "part", "key", "bin", "y"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture
def empty(make, spark):
    return spark.createDataFrame([], DOCS)
