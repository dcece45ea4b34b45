"""Every registered query runs over the smallest tables, returns rows, and equals its SQL where it has one."""

import os

import pytest

from tests.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    _, message, _ = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF_DIR)
    assert message == ""


def test_entry(spark):
    assert entry(spark).count() > 0
