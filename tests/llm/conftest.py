import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with further columns whose names clash with those the operators use inside."""

    def make(texts, first=0):
        rows = [(first + i, t, "en", "s", 1, "clash", 1.0) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, head string, score double")

    return make
