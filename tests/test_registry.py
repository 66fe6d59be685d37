"""The registered queries agree with their oracles on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from workbench.check import connect, difference
from workbench.oracles import ORACLES
from workbench.queries import QUERIES


@pytest.fixture(scope="module")
def oracle(sf_dir):
    return connect(sf_dir)


def test_every_oracle_belongs_to_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, sf_dir, name):
    assert difference(spark, oracle, name, sf_dir) is None
