"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores,
BENCH_RUNS (default 2) the timed runs after one warm-up; the best of them counts. The result of
each query goes to the noop sink. BENCH_DUCKDB=1 also times the equivalent SQL beside it.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from clinframe.queries import ORACLES, QUERIES

HEADLINE = (
    "select_schema",
    "stratified_split",
    "trimmed_stats",
    "zscore",
    "forward_fill",
    "to_sequences",
    "missing_mask",
    "cohort_profile",
    "prepared_cohort",
    "binary_metrics",
    "pr_curve",
    "regression_metrics",
    "osmae",
    "early_score",
    "fairness_report",
    "bootstrap_class_metrics",
    "bootstrap_ranking_metrics",
    "topk_inner_product",
    "multi_corpus_topk",
    "patient_similarity",
    "rank_band",
    "series_text",
    "patient_context",
    "extract_json",
    "peer_opinions",
    "consultation_report",
)


def session(cores: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("clinframe-bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "10g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def duckdb_seconds(sf: str, names, runs: int) -> dict[str, float]:
    import duckdb

    con = duckdb.connect()
    for file in sorted(os.listdir(sf)):
        table = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{file}'")
    out = {}
    for name in names:
        if name in ORACLES:
            spent = []
            for _ in range(runs + 1):
                start = time.perf_counter()
                con.execute(ORACLES[name]).fetchall()
                spent.append(time.perf_counter() - start)
            out[name] = round(min(spent[1:]), 3)
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = session(cores)
    seconds = {}
    for name in names:
        run(spark, name, sf)
        seconds[name] = round(min(run(spark, name, sf) for _ in range(runs)), 3)
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf).removeprefix("sf"),
        "cpus": cores,
    }
    if os.environ.get("BENCH_DUCKDB"):
        result["duckdb"] = duckdb_seconds(sf, names, runs)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
