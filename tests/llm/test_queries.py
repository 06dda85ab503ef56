"""Registered corpus queries: those with SQL give its rows, the others their columns and ids."""

from __future__ import annotations

import pytest
from parity import connect, rows_of

import __spark_entry__
from clinframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    df, result = QUERIES[name](spark, sf), connect(sf).execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_document(spark, sf, name):
    key, table = ("conv_id", "conversations") if name.startswith("op12_") else ("doc_id", "documents")
    ids = [r[key] for r in QUERIES[name](spark, sf).select(key).collect()]
    want = [r[key] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).distinct().collect()]
    assert sorted(ids) == sorted(want)


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
