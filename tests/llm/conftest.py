import pytest


@pytest.fixture
def frame(spark):
    """Makes a table from rows and a schema; also from no rows."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
