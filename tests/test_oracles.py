"""Every query of the library against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from certflume.plans import catalogue
from compare import differences

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, name):
    sql = entry.oracle_sql()[name]
    assert differences(entry.queries()[name](spark, FOLDER), FOLDER, sql) is None


def test_every_query_has_sql():
    assert sorted(catalogue.QUERIES) == sorted(catalogue.ORACLES)
    assert set(catalogue.QUERIES) <= set(entry.queries())
