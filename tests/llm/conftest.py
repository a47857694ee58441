import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, source]) tuples, with a column whose name clashes with inner ones."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA + ", n string")

    return make
