"""Every registered query beside its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, connection, name):
    result, statement = entry.queries()[name](spark, SF_DIR), entry.oracle_sql().get(name)
    if statement is None:
        assert result.count() > 0
    else:
        assert difference(result, connection, statement) is None


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
