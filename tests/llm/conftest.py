import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """Documents from texts (ids from 0) or (id, text) pairs."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make
