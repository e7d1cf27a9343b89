"""No operator leaves a changed session behind."""

import pytest

import __spark_entry__ as entry
from surco.llm.queries import QUERIES


def settings(spark):
    return {r["key"]: r["value"] for r in spark.sql("SET").collect()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_settings_are_as_they_were(spark, smallest, name):
    before = settings(spark)
    QUERIES[name](spark, smallest).count()
    assert settings(spark) == before


def test_settings_after_the_pipeline(spark, smallest):
    before = settings(spark)
    entry.queries()["pipeline"](spark, smallest).count()
    assert settings(spark) == before
