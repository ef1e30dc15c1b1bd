"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle
from featloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    problem, _ = oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "customer_id"
