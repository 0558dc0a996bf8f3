"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

import check_queries
from __spark_entry__ import entry, oracle_sql, queries
from keyloom.plans import load

SF = os.environ.get("KEYLOOM_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def db():
    return check_queries.connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, db, name):
    verdict, _, _ = check_queries.compare(spark, db, name, SF)
    assert verdict == "ok"


def test_every_query_of_the_library_has_sql():
    assert set(load().QUERIES) == set(load().ORACLES)
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() == 200
