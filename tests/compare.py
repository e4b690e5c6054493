"""Run registered queries and their oracles side by side: ``python -m tests.compare SF_DIR [key ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

import __spark_entry__ as registry

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def normalised(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples, columns by name, nulls and number types made equal."""
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    rows = [
        tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row)
        for row in frame.itertuples(index=False, name=None)
    ]
    return sorted(rows, key=repr)


def main(sf_dir: str, keys: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    oracles, failed = registry.oracle_sql(), 0
    for key, query in registry.queries().items():
        if keys and key not in keys:
            continue
        start = time.time()
        result = query(spark, sf_dir)
        ours = result.toPandas()
        took = time.time() - start
        if key not in oracles:
            print(f"{key:30} {took:6.1f}s rows={len(ours)} (no oracle)", flush=True)
            continue
        start = time.time()
        theirs = connection.execute(oracles[key]).df()
        sql_took = time.time() - start
        same_columns = sorted(ours.columns) == sorted(theirs.columns)
        same = same_columns and normalised(ours) == normalised(theirs)
        failed += not same
        print(f"{key:30} {took:6.1f}s sql {sql_took:6.1f}s rows={len(ours)} {len(theirs)} {'ok' if same else 'DIFFERENT'}", flush=True)
        if not same:
            print(sorted(ours.columns), sorted(theirs.columns))
            if same_columns:
                left, right = set(normalised(ours)), set(normalised(theirs))
                print("  only ours  ", sorted(left - right, key=repr)[:3])
                print("  only theirs", sorted(right - left, key=repr)[:3])
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
