"""Cleaning a selected cohort pair. Each step works on its own; ``clean`` chains them.

Thresholds belong to a cohort, and only they (two numbers per step) reach the driver. Filters
compare against them as constants, so a chain of filters is one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cohortlens.functions import number, per_cohort, present, to_number
from cohortlens.model import COHORTS, CompareParams
from cohortlens.operators.hotkeys import ROWS, HotKeys, list_hot, mark_by_key
from cohortlens.operators.numbering import count_rows, number_rows
from cohortlens.operators.selection import PLAY_ORDER, USER
from cohortlens.session import BROADCAST_ROWS, constants, lookup, materialise

NUMBERS = ("numtries", "numcorrect")
# Columns that the empty-value steps do not judge.
BOOKKEEPING = ("cohort", "nth")


# --- empty columns and rows ------------------------------------------------------------------


def column_counts(df: DataFrame) -> dict[int, dict[str, int]]:
    """Values per cohort and column, and all rows under ROWS. NULL and NaN are no values."""
    judged = [c for c in df.columns if c not in BOOKKEEPING]
    kinds = dict(df.dtypes)
    counts = [F.expr(f"count_if({present(c, kinds[c])})").alias(c) for c in judged]
    rows = df.groupBy("cohort").agg(F.count(F.lit(1)).alias(ROWS), *counts).collect()
    return {row["cohort"]: {c: row[c] for c in (ROWS, *judged)} for row in rows}


def empty_columns(counts: Mapping[int, Mapping[str, int]]) -> dict[str, list[int]]:
    """Columns without any value, with the cohorts they are empty in."""
    empty: dict[str, list[int]] = {}
    for cohort, filled in counts.items():
        for column, n in filled.items():
            if n == 0:
                empty.setdefault(column, []).append(cohort)
    return empty


def complete_row(df: DataFrame, empty: Mapping[str, list[int]]) -> str:
    """Condition: no NULL or NaN in any column that has values in the row's cohort."""
    conditions = []
    for column, kind in df.dtypes:
        if column in empty:
            cohorts = ", ".join(map(str, empty[column]))
            conditions.append(f"({present(column, kind)} OR cohort IN ({cohorts}))")
        elif column not in BOOKKEEPING:
            conditions.append(present(column, kind))
    return " AND ".join(conditions)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a value in a cohort; every metric needs both cohorts."""
    return df.drop(*empty_columns(column_counts(df)))


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows with a NULL or NaN, not counting columns without a value in their cohort."""
    return df.filter(complete_row(df, empty_columns(column_counts(df))))


# --- types -----------------------------------------------------------------------------------


def count_unparsable(df: DataFrame) -> DataFrame:
    """Values per cohort that are present but are not numbers."""
    return df.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("plays"),
        *[
            F.expr(f"count_if({c} IS NOT NULL AND ({to_number(c)}) IS NULL)").alias(
                f"{c}_unparsable"
            )
            for c in NUMBERS
            if c in df.columns
        ]
    )


def coerce_numbers(df: DataFrame) -> DataFrame:
    """Turn text into numbers. What does not parse becomes NULL and its row stays."""
    return df.withColumns({c: F.expr(to_number(c)) for c in NUMBERS if c in df.columns})


def playtime_seconds(df: DataFrame) -> DataFrame:
    if "playtime" not in df.columns:
        return df
    return df.withColumn("playtime", F.expr(f"({to_number('playtime')}) / 1000"))


# --- row filters -----------------------------------------------------------------------------
# A NULL fails no threshold, so its row is kept.

Thresholds = dict[int, float | None]


def _not_below(column: str, limits: Thresholds) -> str:
    return f"coalesce(NOT ({column} < {per_cohort(limits)}), true)"


def _not_above(column: str, limits: Thresholds) -> str:
    return f"coalesce(NOT ({column} > {per_cohort(limits)}), true)"


def _performs(minimum: float) -> str:
    return f"coalesce(NOT (numcorrect <= {number(float(minimum))}), true)"


def missing_items_threshold(df: DataFrame, n: int) -> Thresholds:
    rows = df.groupBy("cohort").agg(F.max("numtries").alias("top")).collect()
    return {r["cohort"]: None if r["top"] is None else r["top"] - n for r in rows}


def missing_items_filter(df: DataFrame, n: int) -> DataFrame:
    """Keep plays with at most ``n`` items fewer than the longest play of the cohort."""
    if n <= 0 or "numtries" not in df.columns:
        return df
    return df.filter(_not_below("numtries", missing_items_threshold(df, n)))


def min_performance_filter(df: DataFrame, minimum: float) -> DataFrame:
    """Keep plays with more than ``minimum`` correct."""
    return df.filter(_performs(minimum)) if minimum > 0 else df


def sigma_threshold(df: DataFrame, k: float) -> Thresholds:
    """mean + k sd of ``numcorrect`` per cohort; a negative ``k`` gives the lower limit."""
    rows = (
        df.groupBy("cohort")
        .agg(F.avg("numcorrect").alias("mean"), F.stddev_samp("numcorrect").alias("sd"))
        .collect()
    )
    return {r["cohort"]: None if r["sd"] is None else r["mean"] + r["sd"] * k for r in rows}


def sigma_filter(df: DataFrame, k: float) -> DataFrame:
    """Drop low outliers, then high outliers by the mean and sd of what is left."""
    if k <= 0:
        return df
    low = df.filter(_not_below("numcorrect", sigma_threshold(df, -k)))
    return low.filter(_not_above("numcorrect", sigma_threshold(low, k)))


def level_facts(df: DataFrame) -> DataFrame:
    """Plays and most tries of each session level of a cohort."""
    tries = "max(numtries)" if "numtries" in df.columns else "CAST(NULL AS DOUBLE)"
    return df.groupBy("cohort", "session_level").agg(
        F.count("user_id").alias("_plays"), F.expr(tries).alias("_tries")
    )


def sparse_levels(df: DataFrame, minimum: int) -> DataFrame:
    """Session levels with fewer than ``minimum`` plays in a cohort."""
    return level_facts(df).filter(f"_plays < {minimum}").select("cohort", "session_level")


def sparse_level_filter(df: DataFrame, minimum: int) -> DataFrame:
    if minimum < 0:
        return df
    return df.join(lookup(sparse_levels(df, minimum)), ["cohort", "session_level"], "left_anti")


# --- session numbers and users ---------------------------------------------------------------


def number_sessions(
    df: DataFrame, total: str | None = None, hot: HotKeys | None = None
) -> DataFrame:
    """Add ``session_count``: ``nth`` from the results log where there is one, else play order."""
    order = [c for c in PLAY_ORDER if c in df.columns]
    if "nth" not in df.columns:
        return number_rows(df, USER, order, "session_count", total, hot)
    numbered = number_rows(df, USER, order, "_number", total, hot)
    chosen = F.coalesce(F.col("nth"), F.col("_number"))
    return numbered.withColumn("session_count", chosen).drop("_number", "nth")


def tries_recorded(df: DataFrame) -> bool:
    """Whether both cohorts have plays with at least one try."""
    return _tries_recorded(df.groupBy("cohort").agg(F.max("numtries").alias("_tries")).collect())


def _tries_recorded(rows: Iterable[Row]) -> bool:
    most: dict[int, float] = {}
    for row in rows:
        if row["_tries"] is not None:
            most[row["cohort"]] = max(row["_tries"], most.get(row["cohort"], row["_tries"]))
    return all(tries >= 1 for tries in most.values())


def drop_unused_tries(df: DataFrame) -> DataFrame:
    """Drop ``numtries`` when a cohort never counted a try."""
    if "numtries" not in df.columns or tries_recorded(df):
        return df
    return df.drop("numtries")


def min_sessions_filter(df: DataFrame, minimum: int, hot: HotKeys | None = None) -> DataFrame:
    """Keep users with at least ``minimum`` remaining plays."""
    counted = count_rows(df, USER, "_plays", hot)
    return counted.filter(F.col("_plays") >= minimum).drop("_plays")


# --- the whole chain -------------------------------------------------------------------------


@dataclass(frozen=True)
class Cleaned:
    """The cleaned rows, what each step dropped, and how many values were no numbers."""

    sessions: DataFrame
    audit: DataFrame
    unparsable: DataFrame


def clean(
    df: DataFrame,
    params: CompareParams,
    hot: HotKeys | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> Cleaned:
    """Clean both cohorts in the fixed order of steps, and say what each step dropped.

    ``df`` is read once to look for empty columns. The complete rows, turned into numbers, are
    read once per threshold that is switched on: ``keep`` can set them aside.
    """
    counts = column_counts(df)
    empty = empty_columns(counts)
    complete = df.filter(complete_row(df, empty))
    typed = playtime_seconds(coerce_numbers(complete)).drop(*empty)
    if keep is not None:
        typed = keep(typed)

    steps: list[Step] = []

    def alive() -> DataFrame:
        return typed.filter(_all(steps))

    if params.missing_items > 0 and "numtries" in typed.columns:
        limit = missing_items_threshold(alive(), params.missing_items)
        steps.append(Step("missing_items", _not_below("numtries", limit), limit))
    if "numcorrect" in typed.columns:
        if params.min_performance > 0:
            same = dict.fromkeys(COHORTS, float(params.min_performance))
            steps.append(Step("min_performance", _performs(params.min_performance), same))
        if params.outlier_sigma > 0:
            low = sigma_threshold(alive(), -params.outlier_sigma)
            steps.append(Step("low_outliers", _not_below("numcorrect", low), low))
            high = sigma_threshold(alive(), params.outlier_sigma)
            steps.append(Step("high_outliers", _not_above("numcorrect", high), high))
    by_level = params.min_level_rows >= 0 and "session_level" in typed.columns
    recorded = None
    if by_level:
        keys = ["cohort", "session_level"]
        levels, few = level_facts(alive()), f"_plays < {params.min_level_rows}"
        found = levels.limit(BROADCAST_ROWS + 1).collect()
        if len(found) <= BROADCAST_ROWS:
            # All levels are known now, and with them whether any try is left.
            sparse = [r for r in found if r["_plays"] < params.min_level_rows]
            recorded = _tries_recorded(r for r in found if r["_plays"] >= params.min_level_rows)
            marked = constants(df.sparkSession, sparse, levels.schema)
            marked = marked.selectExpr(*keys, "true AS _sparse")
            typed = typed.join(marked, keys, "left").fillna(False, ["_sparse"])
        else:
            # Counted once; a level with very many plays is not gathered in one task.
            levels = materialise(levels)
            popular = list_hot(levels.selectExpr(*keys, f"_plays AS {ROWS}"), keys)
            left = levels.filter(f"NOT {few}").groupBy("cohort").agg(F.max("_tries").alias("_tries"))
            recorded = _tries_recorded(left.collect())
            typed = mark_by_key(typed, levels.filter(few), keys, popular, "_sparse")
        same = dict.fromkeys(COHORTS, float(params.min_level_rows))
        steps.append(Step("sparse_levels", "NOT _sparse", same))

    kept = alive().drop("_sparse")
    if "numtries" in kept.columns:
        if not (tries_recorded(kept) if recorded is None else recorded):
            kept = kept.drop("numtries")
    numbered = number_sessions(kept, "_plays", hot)
    sessions = numbered.filter(F.col("_plays") >= params.min_sessions)
    order = [c for c in df.columns if c in sessions.columns and c != "nth"]
    fetched = {c: counts[c][ROWS] if c in counts else 0 for c in COHORTS}
    audit = _audit(fetched, typed, steps, kept, params)
    return Cleaned(sessions.select(*order, "session_count"), audit, count_unparsable(complete))


@dataclass(frozen=True)
class Step:
    name: str
    keep: str
    threshold: Thresholds


def _all(steps: list[Step]) -> str:
    return " AND ".join(["true", *(step.keep for step in steps)])


def _audit(
    fetched: Mapping[int, int],
    typed: DataFrame,
    steps: list[Step],
    kept: DataFrame,
    params: CompareParams,
) -> DataFrame:
    """One row per cohort and step, from one aggregate over the rows and one over the users."""
    survivors = [
        F.expr(f"count_if({_all(steps[:i])})").alias(f"_s{i + 1}") for i in range(len(steps) + 1)
    ]
    plays = kept.groupBy(*USER).agg(F.count(F.lit(1)).alias("_plays"))
    by_user = (
        plays.filter(F.col("_plays") >= params.min_sessions)
        .groupBy("cohort")
        .agg(F.sum("_plays").alias("_users_kept"))
    )
    # One row per cohort in all three.
    counted = (
        constants(typed.sparkSession, list(fetched.items()), "cohort int, _s0 bigint")
        .join(F.broadcast(typed.groupBy("cohort").agg(*survivors)), "cohort", "left")
        .join(F.broadcast(by_user), "cohort", "left")
    )
    listed = [
        Step("null_rows", "", {}),
        *steps,
        Step("min_sessions", "", dict.fromkeys(COHORTS, float(params.min_sessions))),
    ]
    after = [f"_s{i}" for i in range(1, len(listed))] + ["_users_kept"]
    entries = [
        f"struct({i + 1} AS position, '{step.name}' AS step,"
        f" coalesce(_s{i}, 0L) AS rows_before, coalesce({after[i]}, 0L) AS rows_after,"
        f" CAST({per_cohort(step.threshold)} AS DOUBLE) AS threshold)"
        for i, step in enumerate(listed)
    ]
    return counted.selectExpr("cohort", f"inline(array({', '.join(entries)}))")
