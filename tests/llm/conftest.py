import pytest
from pyspark.sql import functions as F

LONG = "alpha beta gamma delta " * 8000
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog and runs away from here", "en", "a"),
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "   \n\t ", "en", None),
    (4, "The quick brown fox jumps over the lazy dog and runs away from here", "en", "a"),
    (5, LONG, "en", "b"),
    (6, "un été à la mer\navec des amis\navec des amis et 日本 🙂 <s> ▁x", "fr", "b"),
    (7, "x" * 30000, None, "b"),
    (8, "mail a.b@c.de, call +1 (743) 555-3824, card 4111 1111 1111 1111, host 10.0.0.1 or 999.1.1.1", "en", "c"),
    (8, "mail a.b@c.de, call +1 (743) 555-3824, card 4111 1111 1111 1111, host 10.0.0.1 or 999.1.1.1", "en", "c"),
    (None, "a row without an id has words too, more than ten of them in all, surely", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    df = spark.createDataFrame(TEXTS, SCHEMA)
    for c in ("n_words", "kept", "key", "row", "token", "shard", "n_chars", "ids", "_doc", "comp", "rep", "score", "start"):
        df = df.withColumn(c, F.lit("x"))
    return df.withColumn("n_chars", F.length("text").cast("long")).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
