"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the number of local threads. Each query runs
once to warm up; the median of the following runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from dataclasses import replace

from pyspark.sql import SparkSession

from cohortlens.plans import metrics as mt
from cohortlens.plans.report import compare
from cohortlens.sources.sinks import for_each_table
from verification import fixtures as fx
from verification.queries import BASE, QUERIES, release

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "selected_cohorts",
    "cross_game_session_numbers",
    "observed_session_numbers",
    "cleaned_sessions",
    "cleaning_audit",
    "level_by_session",
    "score_by_session_early",
    "all_curves",
    "plays_per_user",
    "distribution_histograms",
    "distribution_tests",
    "user_level_matrix",
    "jump_by_session",
)


def comparison(spark, sf_dir):
    """Everything a report contains, every table computed in full."""
    params = replace(BASE, sample_users=1000)
    done = compare(spark, fx.plays(spark, sf_dir), params, games=fx.games(spark, sf_dir))
    for_each_table(done.tables, lambda _, table: compute(table))
    done.release()


def compute(table) -> None:
    table.write.format("noop").mode("overwrite").save()


def timed(spark, run) -> float:
    seconds = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        found = run(spark, SF_DIR)
        if found is not None:
            compute(found)
        seconds.append(time.perf_counter() - start)
        release()
    return round(statistics.median(seconds[1:]), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("cohortlens-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [*HEADLINE, *(n for n in os.environ.get("BENCH_EXTRA", "").split(",") if n)]
    times = {"comparison": timed(spark, comparison)}
    times |= {name: timed(spark, QUERIES[name]) for name in names}
    rows = fx.plays(spark, SF_DIR).count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "cpus": int(CPUS),
                "metrics_in_comparison": len(mt.distributions())
                + len(mt.CURVES)
                + len(mt.MATRIX_NEEDS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
