"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry_module
from checks.compare import compare, connect
from checks.oracle import all_sql
from checks.queries import all_queries

LARGE = {"score_points_lineitem"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(all_sql()) == set(all_queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir) is None


def test_entry(spark):
    assert entry_module.entry(spark).count() == 998
