"""The operators that SQL can express give the rows of their SQL twins."""

import compare
import pytest
from llm_cases import SMALL

from veilspark.llm.catalog import ORACLE


@pytest.fixture(scope="module")
def con():
    return compare.database(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    ok, note = compare.compare(spark, con, SMALL, name)
    assert ok, note
