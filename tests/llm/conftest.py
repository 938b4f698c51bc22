import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Odd documents: null, empty, repeated rows, extra columns with clashing names."""

    def make(texts, first=0, **more):
        rows = [(first + i, t, "en", "s", len(t or ""), "x", 7) for i, t in enumerate(texts)]
        names = "doc_id long, text string, lang string, source string, n_chars long, token string, n_words int"
        return spark.createDataFrame(rows, names)

    return make
