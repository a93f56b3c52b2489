import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents from texts; doc_id is the place, lang may be given."""

    def build(texts, langs=None, ids=None):
        rows = [
            (ids[k] if ids else k, t, langs[k] if langs else None, "s", None if t is None else len(t))
            for k, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, SCHEMA)

    return build
