import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: Columns whose names operators might use themselves.
CLASH = ["size", "n", "ident", "key", "range", "target", "h", "d", "kept", "fp", "score", "words", "n_words", "block", "rule"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, or (doc_id, text, source) rows, with clashing extra columns if asked."""

    def make(rows, clash=False):
        full = []
        for k, r in enumerate(rows):
            i, text, source = r if isinstance(r, tuple) else (k, r, f"s{k % 3}")
            full.append((i, text, "en", source, None if text is None else len(text)))
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            for c in CLASH:
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated and tied texts."""
    long = "lorem ipsum dolor sit amet " * 8_000
    return [None, "", " \n\t ", "a", "same text here and there", "same text here and there", long, long + "x", "É ñ 漢字 \x1f z", "x" * 50_000]
