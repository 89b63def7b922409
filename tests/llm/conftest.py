import pytest

from cohortscope.llm.base import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)
