import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text[, lang[, source]]) rows."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)))[:4] for r in rows]
        return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in full], SHAPE)

    return make
