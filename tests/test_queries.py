"""Every named query against its SQL, at the smallest scale."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import check_queries
from patcheval.plans import suite

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(SF)


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(spark, con, name):
    line = check_queries.compare(spark, con, name, SF)
    assert line.startswith("ok") or line.startswith("rows"), line


def test_every_query_has_sql():
    assert set(suite.SQL) == set(suite.QUERIES)


def test_entry_has_every_query():
    assert set(suite.QUERIES) <= set(entry.queries())
    assert set(suite.SQL) <= set(entry.oracle_sql())
