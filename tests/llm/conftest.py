import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents with a clashing extra column; rows are (doc_id, text) or (doc_id, text, source)."""

    def make(rows, extra="ids"):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra} int")

    return make


#: Nulls, empty and long texts, ties and repeated rows.
EDGES = [
    (1, "one two three four five six"),
    (2, None),
    (3, ""),
    (4, "  \t\n "),
    (5, "word " * 5000),
    (6, "one two three four five six"),
    (6, "one two three four five six"),
    (7, "über die Straße\n\n  \x1c naïve 中文 🙂 <|endoftext|> x"),
    (None, "a text without an id"),
    (8, "x" * 30000),
]


@pytest.fixture(scope="session")
def edges():
    return EDGES
