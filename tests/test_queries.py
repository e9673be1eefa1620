"""The driver contract: every query with SQL gives what DuckDB gives; the others have their own tests."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as contract
from tablewright.queries import QUERIES, SQL


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["o_orderstatus", "feature", "rows", "mean_value", "sd_value"]
    assert df.count() == 15


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, oracle.SF_DIR), SQL[name], oracle.SF_DIR) == []
