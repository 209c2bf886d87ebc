import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every awkward case: nulls, empty and long texts, repeated rows, clashing extra columns."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", score double, _text string, _id long, value string" if extra else "")
        full = [(i, t, lang, src, len(t) if t is not None else None) + ((0.5, "x", 7, "v") if extra else ()) for i, t, lang, src in rows]
        return spark.createDataFrame(full, schema)

    return make


AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog.\nAgain and again.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "a"),
    (4, "   \n\t ", "fr", None),
    (5, "word " * 20_000, "en", "b"),
    (6, "x" * 50_000, None, "b"),
    (1, "The quick brown fox jumps over the lazy dog.\nAgain and again.", "en", "a"),
    (None, "No id here, é ß 漢字 \U0001f600", "de", "c"),
    (None, None, None, None),
]


@pytest.fixture(scope="session")
def awkward(docs):
    return docs(AWKWARD)
