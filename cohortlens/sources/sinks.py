"""Writing cohorts, result tables and the record of a run."""

from __future__ import annotations

import datetime
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import TypeVar
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cohortlens.model import CompareParams

T = TypeVar("T")


# By default Spark writes milliseconds, and plays closer than that would lose their order.
CSV_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_csv(df: DataFrame, path: str) -> None:
    """A directory of CSV files with headers, written by all tasks."""
    df.write.mode("overwrite").options(header=True, **CSV_TIMES).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def report_folder(name1: str, name2: str) -> str:
    """``name1``, or ``name1VSname2`` when they differ, without spaces."""
    folder = name1 if name1 == name2 else f"{name1}VS{name2}"
    return folder.replace(" ", "")


def for_each_table(
    tables: Mapping[str, DataFrame], action: Callable[[str, DataFrame], T], at_once: int = 4
) -> list[T]:
    """Run an action per table, a few at once: most tables are small and leave executors idle."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(action, tables.keys(), tables.values()))


def write_report(
    tables: Mapping[str, DataFrame],
    location: str,
    folder: str,
    report: str,
    run_ts: datetime.datetime,
    backup_only: bool = False,
) -> list[str]:
    """Write every result table as a new version of this run, then publish the version as a whole.

    A version's files are never changed. It counts from the moment that its manifest, one small file, is
    there; until then, or if the write is killed, readers see what was published before. A run that is
    written again replaces its own version, and, unless ``backup_only``, the report's current one. Other
    reports are left alone. See ``read_current`` and ``read_history``.
    """
    stamp, version = run_ts.strftime("%Y%m%dT%H%M%S_%f"), uuid.uuid4().hex

    def write(name: str, table: DataFrame) -> str:
        path = _version_path(location, folder, name, report, stamp, version)
        table.write.parquet(path)
        return path

    paths = for_each_table(tables, write)
    if tables:
        spark = next(iter(tables.values())).sparkSession
        written_at = time.time_ns()
        row = (report, stamp, version, written_at, not backup_only, list(tables))
        # A folder of its own, so that reports which are written at once don't meet.
        manifest = f"{location}/published/{folder}/{written_at:020d}-{version}"
        spark.createDataFrame([row], MANIFEST).coalesce(1).write.json(manifest)
    return paths


MANIFEST = (
    "report string, run string, version string, written_at bigint, current boolean, tables array<string>"
)


def _version_path(
    location: str, folder: str, name: str, report: str, stamp: str, version: str
) -> str:
    base = f"{location}/history/{folder}/{name}"
    return f"{base}/report={quote(report, safe=' ')}/run={stamp}/version={version}"


def published(spark: SparkSession, location: str, folder: str) -> list[Row]:
    """Manifests of a folder in the order of their publication, one row per written run."""
    try:
        found = spark.read.schema(MANIFEST).json(f"{location}/published/{folder}/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    rows = found.filter("version IS NOT NULL").collect()
    return sorted(rows, key=lambda row: (row["written_at"], row["version"]))


def read_current(
    spark: SparkSession, location: str, folder: str, report: str
) -> dict[str, DataFrame]:
    """Tables of the report's current version, all of the same run; none if nothing is published."""
    named = [m for m in published(spark, location, folder) if m["report"] == report and m["current"]]
    if not named:
        return {}
    last = named[-1]
    key = (report, last["run"], last["version"])
    return {
        name: spark.read.parquet(_version_path(location, folder, name, *key)) for name in last["tables"]
    }


def read_history(spark: SparkSession, location: str, folder: str, name: str) -> DataFrame:
    """A table over all reports and runs of a folder, each run in its last published version.

    ``report`` and ``run`` are added. Columns that a run's table lacks are NULL.
    """
    last = {
        (m["report"], m["run"]): m["version"]
        for m in published(spark, location, folder)
        if name in m["tables"]
    }
    parts = [
        spark.read.parquet(_version_path(location, folder, name, *key, version)).withColumns(
            {"report": F.lit(key[0]), "run": F.lit(key[1])}
        )
        for key, version in last.items()
    ]
    if not parts:
        raise ValueError(f"no run of {folder!r} has a table {name!r}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def run_record(
    spark: SparkSession,
    params: CompareParams,
    run_ts: datetime.datetime,
    plans: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row that says what was run, when, and with which settings and logical plans."""
    return spark.createDataFrame(
        [(params.report, run_ts, params.as_text(), dict(plans or {}))],
        "report string, run_ts timestamp, settings map<string,string>, plans map<string,string>",
    )
