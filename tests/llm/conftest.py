import pytest

from rankflow.session import ship_package


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs."""
    def make(rows, extra=""):
        return spark.createDataFrame(rows, "doc_id long, text string" + extra)
    return make
