import pytest


@pytest.fixture
def docs_frame(spark):
    """Makes documents from tuples of doc_id, text, lang, source."""

    def make(rows):
        return spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")

    return make
