"""The game catalog: a kept snapshot, and names for the cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.model import COHORTS, GAMES
from cohortlens.session import constants


def read_games(source: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """The catalog under our names. ``columns`` says what the source calls them where it differs; a
    column that the source lacks is NULL."""
    called = {field.name: field.name for field in GAMES} | dict(columns or {})
    have = {c.lower() for c in source.columns}
    return source.select(
        *[
            (F.col(called[f.name]) if called[f.name].lower() in have else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in GAMES
        ]
    )


def game_catalog(
    spark: SparkSession, source: DataFrame, snapshot: str, refresh: bool = False
) -> DataFrame:
    """The catalog from its snapshot; written first if there is none or ``refresh`` is set."""
    if not refresh:
        try:
            return spark.read.schema(GAMES).parquet(snapshot)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    read_games(source).write.mode("overwrite").parquet(snapshot)
    return spark.read.schema(GAMES).parquet(snapshot)


def cohort_names(
    games: DataFrame, game_ids: Sequence[int], labels: Sequence[str] = ("", "")
) -> DataFrame:
    """Display name of each cohort: label, game name and ``#id``.

    ``matches`` says how many catalog rows the game has; only 1 gives a name.
    """
    wanted = constants(
        games.sparkSession,
        [(c, int(g), label) for c, g, label in zip(COHORTS, game_ids, labels)],
        "cohort int, game_id bigint, label string",
    )
    names = (
        games.filter(F.col("id").isin(*set(game_ids)))
        .groupBy(F.col("id").alias("game_id"))
        .agg(F.count(F.lit(1)).alias("matches"), F.max("name").alias("game"))
    )
    # Two rows, as many as there are cohorts.
    joined = wanted.join(F.broadcast(names), "game_id", "left")
    named = F.concat(
        F.col("label"), F.lit(" "), F.col("game"), F.lit(" #"), F.col("game_id").cast("string")
    )
    return joined.select(
        "cohort",
        "game_id",
        F.coalesce(F.col("matches"), F.lit(0)).alias("matches"),
        F.when(F.col("matches") == 1, named).alias("name"),
    )
