"""The registered queries of the corpus operators at the smallest scale."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import check_queries
from patcheval.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_query(spark, name):
    line = check_queries.compare(spark, check_queries.connect(SF), name, SF)
    assert line.startswith("ok" if name in queries.SQL else "rows"), line


def test_entry_has_them():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
