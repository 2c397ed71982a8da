"""Every registered query against its SQL on the smallest test tables."""

import re

import pytest

import __spark_entry__ as registry
from oracle.compare import compare, connect


@pytest.fixture(scope="module")
def engine(folder):
    return connect(folder)


OWN = [n for n in registry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)]


def test_every_query_has_sql():
    assert set(OWN) <= set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", OWN)
def test_matches_sql(spark, engine, folder, name):
    same, detail = compare(spark, engine, folder, registry.queries()[name], registry.oracle_sql()[name])
    assert same, detail


def test_entry_is_stable(spark):
    result = registry.entry(spark)
    assert result.count() > 0
    assert result.schema == registry.entry(spark).schema
