import random

import pytest
from pyspark.sql import types as T

from corpora import sentence, vocabulary

#: More columns than the operators know, with names that they use themselves.
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), *[T.StructField(c, T.StringType()) for c in (
                         "rid", "page", "n", "shard", "rate", "label", "words", "grp", "score", "kept", "h", "item_id", "digest")]])
EXTRA = ["x"] * 13


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, lang)."""
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", *EXTRA) for r in rows], DOCS)
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, ties, repeated rows, one very long text."""
    rng = random.Random(5)
    v = vocabulary(rng)
    text = sentence(rng, 60, v)
    return [(1, None), (2, ""), (3, " \t\n "), (4, text), (4, text), (4, text), (5, text), (6, text + " more"), (7, "A b"), (None, text),
            (8, sentence(rng, 60_000, v)), (9, "é中 \x00\x1f ok"), (9, "another text of the same id"), (10, "!!! ... 123")]


@pytest.fixture(scope="session")
def no_rows():
    return []
