import pytest

import __spark_entry__ as contract
from tests.parity import compare
from workload.queries import QUERIES


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    ok, note = compare(spark, "sf0.001", name)
    assert ok, note


def test_entry(spark):
    assert contract.entry(spark).count() > 0
