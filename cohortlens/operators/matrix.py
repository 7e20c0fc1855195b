"""User by session matrix, its ordering and systematic sample, and level stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.numbering import number_rows
from cohortlens.operators.prefix import running_totals
from cohortlens.operators.selection import PLAY_ORDER, USER

LEVEL_STOPS = 12


def first_sessions(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` lowest session numbers of each cohort, with their place from 1.

    Distinct numbers only, and Spark keeps ``n`` per task before the shuffle.
    """
    window = Window.partitionBy("cohort").orderBy("session_count")
    place = F.row_number().over(window)
    return (
        df.select("cohort", "session_count")
        .distinct()
        .withColumn("place", place)
        .filter(F.col("place") <= n)
    )


def level_matrix(df: DataFrame, n: int) -> DataFrame:
    """Highest level of each user at the cohort's first ``n`` session numbers.

    Users who miss one of them are left out. A cohort with fewer session numbers has NULL in
    the columns it lacks.
    """
    places = first_sessions(df, n)
    # At most 2n rows, n being a parameter.
    placed = df.join(F.broadcast(places), ["cohort", "session_count"])
    wide = (
        placed.groupBy("cohort", "user_id")
        .pivot("place", list(range(1, n + 1)))
        .agg(F.max("session_level"))
    )
    named = wide.toDF("cohort", "user_id", *matrix_columns(n))
    available = places.groupBy("cohort").agg(F.count(F.lit(1)).alias("_available"))
    filled = sum((F.col(c).isNotNull().cast("int") for c in matrix_columns(n)), F.lit(0))
    return (
        named.join(F.broadcast(available), "cohort")
        .filter(filled == F.col("_available"))
        .drop("_available")
    )


def matrix_columns(n: int) -> list[str]:
    return [f"s{i}" for i in range(1, n + 1)]


def ordered_users(matrix: DataFrame, window_rows: int | None = None) -> DataFrame:
    """Users in order of their levels, with an ordinal from 0 in each cohort."""
    order = [c for c in matrix.columns if c not in USER] + ["user_id"]
    placed = running_totals(matrix, ["cohort"], order, {"_place": F.lit(1)}, window_rows)
    return placed.withColumn("ordinal", F.col("_place") - 1).drop("_place")


def sample_users(
    matrix: DataFrame, most: int | None = None, window_rows: int | None = None
) -> DataFrame:
    """All users in level order, or every k-th of each cohort, so that about ``most`` remain.

    k = round(users / most), half to even; the first user is never taken and at most
    ``most - 1`` are. With k = 1 the last ``most`` users are taken first ("top"). A cohort of
    at most ``most`` users stays whole.
    """
    ordered = ordered_users(matrix, window_rows)
    if most is None:
        return ordered.withColumn("sample", F.lit("all"))
    sizes = matrix.groupBy("cohort").agg(F.count(F.lit(1)).alias("_users"))
    # One row per cohort on the broadcast side.
    return (
        ordered.join(F.broadcast(sizes), "cohort")
        .selectExpr("*", f"IF(_users > {most}, CAST(bround(_users / {most}) AS BIGINT), 0) AS _step")
        .selectExpr("*", f"IF(_step = 1, ordinal - (_users - {most}), ordinal) AS _place")
        .selectExpr(
            "*",
            "CASE _step WHEN 0 THEN 'all' WHEN 1 THEN 'top' ELSE 'downsampled' END AS sample",
        )
        .filter(
            "_step = 0 OR (_place > 0 AND try_mod(_place, _step) = 0"
            f" AND try_divide(_place, _step) <= {most - 1})"
        )
        .drop("_users", "_step", "_place")
    )


def level_stops(matrix: DataFrame, stops: int = LEVEL_STOPS) -> DataFrame:
    """Evenly spaced levels between the lowest and highest of each cohort's matrix."""
    levels = [c for c in matrix.columns if c.startswith("s") and c[1:].isdigit()]
    low = [F.min(c) for c in levels]
    high = [F.max(c) for c in levels]
    ends = matrix.groupBy("cohort").agg(
        (F.least(*low) if len(low) > 1 else low[0]).cast("double").alias("_low"),
        (F.greatest(*high) if len(high) > 1 else high[0]).cast("double").alias("_high"),
    )
    step = (F.col("_high") - F.col("_low")) / (stops - 1)
    return (
        ends.withColumn("stop", F.explode(F.sequence(F.lit(0), F.lit(stops - 1))))
        .withColumn("level", F.col("_low") + F.col("stop") * step)
        .select("cohort", "stop", "level")
    )


def jump_by_session(df: DataFrame, n: int, play_order: bool = False, hot=None) -> DataFrame:
    """Mean level jump at each user's first ``n`` plays, with each cohort's extremes.

    ``session_count`` already is the play order unless it came from the results log; then
    ``play_order`` numbers the plays again.
    """
    if play_order:
        order = [c for c in PLAY_ORDER if c in df.columns]
        numbered = number_rows(df, USER, order, "_number", hot=hot)
        number = F.col("_number") - 1
    else:
        numbered, number = df, F.col("session_count") - 1
    jumps = (
        numbered.withColumn("key", number)
        .filter(F.col("key") < n)
        .withColumn("_jump", F.col("user_level") - F.col("session_level"))
    )
    points = jumps.groupBy("cohort", "key").agg(
        F.count("_jump").alias("n"),
        F.avg("_jump").alias("mean"),
        F.stddev_samp("_jump").alias("sd"),
        F.min("_jump").alias("_low"),
        F.max("_jump").alias("_high"),
    )
    ends = points.groupBy("cohort").agg(
        F.min("_low").alias("lowest_jump"), F.max("_high").alias("highest_jump")
    )
    return points.drop("_low", "_high").join(F.broadcast(ends), "cohort")
