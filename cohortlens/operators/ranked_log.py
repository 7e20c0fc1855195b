"""A results log that is kept with its session numbers, so that new results are ranked alone.

Per user and game the log holds how many results there are and the last id. New results come after these:
their numbers are their ranks among the new ones plus that count, so an append sorts only what is new. Results
with an id up to the last one of their user are late; then the whole log is ranked anew. What is written is
never changed; a manifest names the parts that count, so readers see a log before or after an append.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.numbering import rank_results
from cohortlens.session import materialise

MODES = {"true": ["game_id", "user_id"], "cross_game": ["user_id"]}
_MANIFEST = "parts array<string>, counts string, games array<bigint>, written_at bigint, version string"
_LOG = "id bigint, game_id bigint, user_id bigint, nth_true bigint, nth_cross_game bigint"


def append_results(path: str, new: DataFrame, games: Iterable[int]) -> None:
    """Add the results of the given games (``id``, ``game_id``, ``user_id``) to the log at ``path``.

    The games are part of a number across games, so a log is kept for a fixed set of them. Results of other
    games are left out. NULL is a user like any other, and results with one id share a number, as in
    ``rank_results``. An empty batch changes nothing.
    """
    spark, games = new.sparkSession, sorted(set(games))
    fresh = materialise(
        new.select(*(F.col(c).cast("bigint").alias(c) for c in ("id", "game_id", "user_id"))).filter(
            F.col("game_id").isin(*games)
        )
    )
    if fresh.isEmpty():
        return
    last = _last(spark, path)
    if last is not None and list(last["games"]) != games:
        raise ValueError(f"the log is kept for the games {last['games']}")
    parts, counts = ([], None) if last is None else (list(last["parts"]), spark.read.parquet(last["counts"]))
    if counts is not None and _any_late(fresh, counts):
        fresh = materialise(fresh.unionByName(spark.read.schema(_LOG).parquet(*parts).select(*fresh.columns)))
        parts, counts = [], None
    ranked = fresh
    for mode, keys in MODES.items():
        ranked = rank_results(ranked, keys, f"nth_{mode}")
    if counts is not None:
        for mode, keys in MODES.items():
            known = counts.groupBy(*keys).agg(F.sum("n").alias("_before"))
            known = known.toDF(*(f"_{k}" for k in keys), "_before")
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            ranked = ranked.join(known, same, "left").withColumn(
                f"nth_{mode}", F.col(f"nth_{mode}") + F.coalesce("_before", F.lit(0))
            ).drop("_before", *(f"_{k}" for k in keys))
    version = uuid.uuid4().hex
    part, total = f"{path}/parts/{version}", f"{path}/counts/{version}"
    ranked.select("id", "game_id", "user_id", "nth_true", "nth_cross_game").write.parquet(part)
    added = fresh.groupBy("game_id", "user_id").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    if counts is not None:
        added = added.unionByName(counts).groupBy("game_id", "user_id").agg(
            F.sum("n").alias("n"), F.max("last").alias("last")
        )
    added.write.parquet(total)
    row = ([*parts, part], total, games, time.time_ns(), version)
    manifest = f"{path}/manifests/{row[3]:020d}-{version}"
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.json(manifest)


def _any_late(fresh: DataFrame, counts: DataFrame) -> bool:
    """Whether a result is not after all kept ones of its user."""
    first = fresh.groupBy("user_id").agg(F.min("id").alias("first"))
    last = counts.groupBy(F.col("user_id").alias("_user")).agg(F.max("last").alias("last"))
    late = first.join(last, F.col("user_id").eqNullSafe(F.col("_user"))).filter("first <= last")
    return not late.isEmpty()


def _last(spark: SparkSession, path: str) -> Row | None:
    try:
        found = spark.read.schema(_MANIFEST).json(f"{path}/manifests/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rows = found.filter("version IS NOT NULL").orderBy(F.desc("written_at"), F.desc("version")).head(1)
    return rows[0] if rows else None


def read_ranked(spark: SparkSession, path: str) -> DataFrame:
    """The log with ``nth_true`` and ``nth_cross_game``, for ``select_cohorts`` as its results log."""
    last = _last(spark, path)
    if last is None:
        raise ValueError(f"no results log is kept at {path!r}")
    return spark.read.schema(_LOG).parquet(*last["parts"])
