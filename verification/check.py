"""Run registered queries in Spark and their oracles in DuckDB, and compare all values.

    python -m verification.check [SF_DIR] [QUERY ...]
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

from verification.oracles import ORACLES
from verification.queries import QUERIES, release

TABLES = (
    *("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"),
    *("documents", "embeddings", "pages", "benchmark", "labels", "conversations"),
)


def duckdb_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def _plain(value):
    """Numbers as text to the last digit, so that 0 and -0 differ as well."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        return repr(float(value))
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is None, str(v)) for v in row),
    )


def compare(spark: SparkSession, connection, sf_dir: str, name: str) -> str:
    """Empty if both sides agree, else what differs."""
    found = QUERIES[name](spark, sf_dir)
    rows = found.collect()
    cursor = connection.execute(ORACLES[name])
    expected_columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(found.columns) != sorted(expected_columns):
        return f"columns {sorted(found.columns)} != {sorted(expected_columns)}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    mine, theirs = _sorted_rows(found.columns, rows), _sorted_rows(expected_columns, expected)
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{sorted(found.columns)}\n    spark  {a}\n    duckdb {b}"
    return "" if rows else "no rows"


def main(arguments: list[str]) -> int:
    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb_tables(sf_dir)
    failures = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        release()
        failures += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s", flush=True)
        if problem:
            print(f"    {problem}", flush=True)
    missing = sorted(set(QUERIES) - set(ORACLES))
    print(f"{len(names) - failures} of {len(names)} agree; without an oracle: {missing}")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
