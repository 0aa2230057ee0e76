import pytest


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) pairs, with extra columns that clash with result names."""

    def make(rows):
        kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"
        full = [(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in rows]
        return spark.createDataFrame(full, kind)

    return make
