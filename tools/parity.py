"""Compare registered queries with their SQL on one scale factor.

usage: python tools/parity.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clinframe.queries import ORACLES, QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "10g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return repr(round(number + 0.0, 9))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


def compare(spark, con, name: str, sf: str) -> str:
    start = time.time()
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if name not in ORACLES:
        return f"ROWS  {len(got):8d} {spent:6.2f}s"
    start = time.time()
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = result.fetchall()
    duck = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"FAIL  columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return f"OK    {len(got):8d} {spent:6.2f}s duck {duck:6.2f}s"
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return f"FAIL  rows {len(a)} vs {len(b)}\n   spark {str(only_a)[:600]}\n   duck  {str(only_b)[:600]}"


def main() -> int:
    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    parts = args[1:]
    spark, con, bad = session(), connect(sf), 0
    for name in QUERIES:
        if parts and not any(p in name for p in parts):
            continue
        try:
            line = compare(spark, con, name, sf)
        except Exception as error:  # noqa: BLE001
            line = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += not line.startswith(("OK", "ROWS"))
        print(f"{name:34s} {line}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
