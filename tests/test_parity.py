"""Every registered query with SQL gives the same rows as that SQL in DuckDB."""

from __future__ import annotations

import pytest
from parity import compare, connect

import __spark_entry__
from clinframe.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    line = compare(spark, con, name, sf)
    assert line.startswith("OK"), line


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
