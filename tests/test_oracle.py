"""Every query with a SQL twin gives the same rows as DuckDB on the small tables."""

import __spark_entry__ as entry
import compare
import pytest
from conftest import SMALL

from veilspark.catalog import registered

QUERIES, ORACLE = registered.QUERIES, registered.ORACLE
ROWS_ONLY = {
    "sign_test_mc", "cv_random_forest", "cv_bagging", "cv_boosting",
    "cv_logistic", "cv_network", "cv_holdout",
}


@pytest.fixture(scope="module")
def con():
    return compare.database(SMALL)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert not set(ORACLE) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    ok, note = compare.compare(spark, con, SMALL, name)
    assert ok, note


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["fk_before"] >= row["fk_after"]
