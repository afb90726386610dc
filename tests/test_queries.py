"""Every registered query with SQL must equal DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    assert oracle.compare(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 5
