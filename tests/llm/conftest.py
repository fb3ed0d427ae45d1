import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents with the usual columns and one more that clashes with what operators make."""

    def make(rows):
        rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make
