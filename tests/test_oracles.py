"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(smallest):
    return oracle.connect(smallest)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, smallest, name):
    assert oracle.compare(spark, con, smallest, name, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, smallest, name):
    rows = QUERIES[name](spark, smallest).collect()
    assert rows


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
