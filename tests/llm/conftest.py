import pytest
from cases import SCHEMA, awkward_rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    """(doc_id, text) of the small table."""
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
