"""Every registered query against its SQL statement, over whole tables."""

from __future__ import annotations

import os

import pytest

from tests.compare import connect, difference
from zealmark.plans import oracles, registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, STATEMENTS = registry.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, STATEMENTS[name]) is None
