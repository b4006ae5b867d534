"""Every query of the library's own products against its SQL on the smallest check tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, duck
from checks.oracle import ORACLE
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_registry_holds_them():
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
