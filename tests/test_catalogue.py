"""Every query against its SQL on the smallest tables; those without SQL give rows."""

import pytest
from conftest import DATA, same

from corpusql import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, name):
    same(catalogue.QUERIES[name](spark, DATA), duck, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_gives_rows(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert df.columns and df.limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
