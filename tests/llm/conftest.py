"""Small document tables with the cases every operator must stand."""

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside, as columns of the input
    *[T.StructField(c, T.StringType()) for c in ("fp", "node", "d", "t", "s", "pos", "removed_spans", "epoch", "score", "shard")],
])


def words(n, start=0):
    """n words that only this range of numbers has."""
    return " ".join(f"w{i:05d}x" for i in range(start, start + n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        full = [(i, text, lang, source, len(text) if text is not None else None, *["z"] * 10) for i, text, lang, source in rows]
        return spark.createDataFrame(full, DOCUMENTS)
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty, blank and long texts, copies, near copies, repeated rows and ids."""
    base = words(120)
    long = "\n".join(words(40, 40 * i) for i in range(500))
    return make_docs([
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace("w00119x", "other"), "en", "b"),
        (4, None, None, None), (5, "", "de", "a"), (6, " \t\n ", "de", None), (7, "one", "fr", "b"), (7, "one", "fr", "b"),
        (None, words(60, 9000), "fr", "b"), (None, None, None, None), (8, long, "en", "a"), (9, long, "en", "a"),
        (10, "ÄÖ äö ÀÉ 12 <|endoftext|> x", "de", "c"), (7, "one two three", "fr", "b"),
    ])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
