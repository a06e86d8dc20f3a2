"""Every registered query against its DuckDB statement on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    statement = contract.oracle_sql().get(name)
    if statement is None:
        assert df.count() > 0
    else:
        assert oracle.compare(df, con, statement) is None


def test_entry(spark):
    assert contract.entry(spark).columns == ["ip_slug", "primary_id", "accepted", "n_members"]


def test_checks_name_known_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
