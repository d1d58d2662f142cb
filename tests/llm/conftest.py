import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, kept string, row long"


@pytest.fixture
def docs(spark):
    """Makes documents (with extra columns of clashing names) from (doc_id, text[, lang]) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", "y", 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def edge(docs):
    """Nulls, empty and long texts, and repeated rows."""
    return docs([(1, None), (2, ""), (3, "word " * 30000), (None, "Some text here without an id."), (4, "twice the same row"), (4, "twice the same row"), (5, " \n\t\n"), (6, "é" * 50)])
