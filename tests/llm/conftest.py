import pytest


@pytest.fixture
def make(spark):
    """A table from rows and a schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
