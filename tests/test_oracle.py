"""Every registered query on the smallest tables, against its SQL."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, database

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return database(SF_DIR)


def test_names():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    assert compare(spark, connection, SF_DIR, name) is None
