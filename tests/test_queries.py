"""Every registered query on the small tables, next to its SQL."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL
from oracle import compare, connect

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SMALL)
    assert ok, note


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)


#: Queries that other tests compare with brute force or fixtures.
WITHOUT_SQL = {
    f"render_{kind}_{output}" for kind in ("topic_search", "trending") for output in ("json", "markdown", "text")
}


def test_every_other_query_has_sql():
    optional = {name for name in QUERIES if name == "pipeline" or re.match(r"op\d+_", name)}
    assert set(QUERIES) - set(ORACLES) - optional == WITHOUT_SQL
