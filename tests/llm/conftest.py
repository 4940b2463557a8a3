import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, key string, target double"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table (with further columns whose names operators also use) from (doc_id, text[, lang, source]) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or ""), "x", "k", 1.5) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, a null id, a repeated row, a tie and a very long text."""
    return [
        (5, "alpha beta gamma delta", "en", "b"), (3, "alpha  beta gamma delta", "en", "a"), (3, "alpha  beta gamma delta", "en", "a"), (7, None, None, None), (8, "", "en", "b"), (9, " \n\t ", "fr", "b"),
        (None, "lonely text of nobody", "en", "b"), (11, "word " * 30_000, "en", "a"), (12, "Straße <|endoftext|> é漢字 🙂\r\n  x", "de", None), (13, "x", "en", "a"),
    ]
