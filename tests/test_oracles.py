"""Every registered query of the core library against its SQL; those without SQL must give rows."""

import pytest
from oracle import connect, differences

from docketry import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, sf_dir, name):
    assert differences(spark, con, QUERIES[name], SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert not QUERIES[name](spark, sf_dir).isEmpty()


def test_entry_works_without_the_optional_part(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert not e.entry(spark).isEmpty()
