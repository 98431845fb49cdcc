import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import DOCS, hard_rows  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(hard_rows(), DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
