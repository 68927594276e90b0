import pytest

from tests.llm import fixtures


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(fixtures.documents(), fixtures.SCHEMA).repartition(5, "doc_id").cache()


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1]) for r in fixtures.documents()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty texts, repeated rows, and columns whose names the operators use themselves."""
    return spark.createDataFrame(fixtures.odd(), fixtures.SCHEMA + ", kept boolean, doc long, version string, n_words string, start int, gram string, size string, block int")
