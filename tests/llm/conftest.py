import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                          T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table from ``(doc_id, text)`` or ``(doc_id, text, lang, source)`` rows."""
    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)
    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empty and long texts, ties and repeated rows."""
    return documents([(1, None), (2, ""), (3, " \t\n"), (4, "word"), (4, "word"), (5, "word "), (None, "word"),
                      (None, None), (6, "a b " * 50_000), (7, "x" * 200_000), (8, "École école \U0001f600 naïve"),
                      (9, None, None, None), (9, "other text", "en", "s")])
