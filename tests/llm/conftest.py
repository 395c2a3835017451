import pytest
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use for columns of their own.
    T.StructField("score", T.StringType()), T.StructField("size", T.StringType()), T.StructField("key", T.StringType()), T.StructField("range", T.StringType()),
])


def frame(spark, rows) -> DataFrame:
    """Rows of (doc_id, text[, lang[, source]]) as documents with extra columns."""
    full = [(*r, *(None,) * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(d, t, la, s, None if t is None else len(t), "x", "y", None, "z") for d, t, la, s in full], DOCUMENT)


def words(n: int, seed: int = 0) -> str:
    import random

    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 8))) for _ in range(n))


SHARED = words(60, 99)


@pytest.fixture(scope="session")
def cases():
    """Nulls, empty and very long texts, ties, repeated rows and ids, code points beyond the basic plane."""
    long = words(6000, 1)
    return [
        (1, words(120, 2), "en", "a"), (2, None, "en", "a"), (3, "", "de", "b"), (4, " \n\t", "de", None), (5, long, None, "b"),
        (6, long, "en", "a"), (6, long, "en", "a"), (7, words(120, 2) + " tail", "en", None), (8, "😀 ünï", "fr", "c"), (9, "one", "fr", "c"),
        (10, SHARED + " " + words(30, 3), "en", "a"), (11, words(20, 4) + " " + SHARED, "en", "a"), (None, SHARED, None, None),
        (12, words(40, 5), "en", "a"), (12, words(41, 6), "en", "a"), (13, "a" * 700, "en", "d"), (14, "line\n\nline\n" * 40, "de", "b"),
    ]
