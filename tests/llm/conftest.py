import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents of texts: (id, text) or (id, text, lang, source)."""

    def make(rows):
        full = [(*r, *("en", "s")[len(r) - 2 :])[:4] if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in full], DOCS)

    return make


ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "one"), (None, None), (4, "word " * 60_000), (5, "\x00퟿ é 漢"), (6, "   \n\t ")]


@pytest.fixture
def odd(docs):
    """Nulls, empty and long texts, repeated rows, null ids, and extra columns with names that operators use."""
    from pyspark.sql import functions as F

    df = docs(ODD)
    for name in ("score", "size", "taken", "_key", "fp", "spans", "spans_", "blob_id", "TEXT_", "_row", "bucket", "label"):
        df = df.withColumn(name, F.lit("x"))
    return df
