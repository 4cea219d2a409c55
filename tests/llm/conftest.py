"""Tables that every operator is tried on."""

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghiklmnorstu", k=r.randint(2, 9))) for _ in range(400)]
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, special strings and invalid-looking text."""
    long = prose(1, 30_000)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\x0b\f\r ", None, "a", 7), (4, "one", "en", None, 3),
        (5, long, "en", "b", len(long)), (6, long, "de", "b", None), (7, long + " more", None, None, None),
        (8, "<|endoftext|> <s> [INST]   ▁x \x00 \U0001f600 日本語", "en", "c", 1),
        (9, prose(2, 80), "en", "c", 1), (9, prose(2, 80), "en", "c", 1), (9, prose(3, 80), "en", "c", 1),
        (10, "a " * 600, "en", "c", 1), (11, "=" * 3000, "fr", "c", 1), (None, prose(4, 70), "en", "a", 1),
        (None, None, None, None, None), (12, prose(5, 60) + "\n" + prose(6, 60), "en", "a", 1),
        (13, prose(6, 60) + "\n" + prose(7, 60), "en", "a", 1), (14, "One TWO three four", "en", "a", 1), (15, "one two three four", "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["n_words", "node", "d", "t", "size", "score", "kept", "h", "piece", "length", "stratum", "_row", "s", "off", "_text", "_m", "spans", "set_key", "_gone", "_id", "_at", "shard_id", "chain", "p", "bytes", "band", "component", "_odd_id", "owner", "_salt", "a.b", "c`d", "k", "_copies"]
    return odd_docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(9, 1, 0), (10, 0, 0), (11, 0, None), (12, 1, 0), (12, None, 0), (13, 1, 1), (None, 1, 0), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
