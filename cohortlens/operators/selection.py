"""Selecting the two cohorts from the play table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import age, json_fields, per_cohort, whole_number
from cohortlens.model import COHORTS, CompareParams
from cohortlens.operators.hotkeys import ROWS, HotKeys, count_keys, filter_by_key, list_hot
from cohortlens.operators.numbering import count_results, rank_results
from cohortlens.session import materialise

USER = ["cohort", "user_id"]
PLAY_ORDER = ["event_created_at", "game_result_id"]
CARRIED = [
    "cohort",
    "game_id",
    "game_result_id",
    "user_id",
    "created_at",
    "event_created_at",
    "user_level",
    "session_level",
    "score",
]
OUTPUT = [
    "cohort",
    "game_result_id",
    "user_id",
    "event_created_at",
    "user_level",
    "session_level",
    "score",
    "numcorrect",
    "numtries",
    "playtime",
    "nth",
]


def tag_cohorts(plays: DataFrame, params: CompareParams) -> DataFrame:
    """Rows of either cohort, with a ``cohort`` column, from a single scan.

    A row that belongs to both cohorts (one game in overlapping periods) comes out twice.
    """
    conditions = [_member(plays, params, i) for i in range(2)]
    frame = plays.filter(_prunable(plays, params)).filter(conditions[0] | conditions[1])
    if params.game_ids[0] != params.game_ids[1]:
        return frame.withColumn("cohort", F.when(conditions[0], 1).otherwise(2))
    memberships = [F.when(c, F.lit(k)) for k, c in zip(COHORTS, conditions)]
    return frame.withColumn("cohort", F.explode(F.array_compact(F.array(*memberships))))


def _member(plays: DataFrame, params: CompareParams, i: int) -> Column:
    condition = F.col("game_id") == params.game_ids[i]
    if params.years is not None:
        condition &= _year(plays).isin(*params.years)
    if params.months is not None:
        condition &= _month(plays) == params.months[i]
    return condition


def _year(plays: DataFrame) -> Column:
    return F.col("yyyy") if "yyyy" in plays.columns else F.year("created_at")


def _month(plays: DataFrame) -> Column:
    return F.col("mm") if "mm" in plays.columns else F.month("created_at")


def _prunable(plays: DataFrame, params: CompareParams) -> Column:
    """What both cohorts imply, as plain conjuncts that reach the file scan."""
    condition = F.col("game_id").isin(*set(params.game_ids))
    if params.years is not None:
        condition &= _year(plays).isin(*params.years)
        if "yyyy" not in plays.columns and params.years:
            kind = _timestamp_type(plays)
            condition &= F.expr(
                f"created_at >= {kind}'{min(params.years)}-01-01'"
                f" AND created_at < {kind}'{max(params.years) + 1}-01-01'"
            )
    if params.months is not None:
        condition &= _month(plays).isin(*set(params.months))
    return condition


def _timestamp_type(df: DataFrame) -> str:
    """Constants of the column's own type need no cast, which would hide it from the scan."""
    return dict(df.dtypes)["created_at"].upper()


def extract_fields(plays: DataFrame, params: CompareParams) -> DataFrame:
    """Narrow the tagged rows to the columns the comparison uses.

    Values come from the ``metadata`` JSON if there is one, where labels are paths
    (``summary.num_correct``), else from columns of the same name. NaN becomes NULL. It runs
    before any shuffle, so the blob itself is never moved.
    """
    labels = {
        "numcorrect": params.correct_label,
        "numtries": params.tries_label,
        "playtime": params.playtime_label,
    }
    kinds = dict(plays.dtypes)
    columns = {
        name: f"nanvl({name}, NULL)" if kinds[name] in ("double", "float") else name
        for name in CARRIED
        if name in kinds
    }
    if "metadata" in plays.columns:
        wanted = [name for pair in labels.values() for name in pair]
        parsed, read = json_fields("metadata", [*wanted, "selected_level", "version"])
        plays = plays.withColumns({name: F.expr(text) for name, text in parsed.items()})
        for name, (first, second) in labels.items():
            columns[name] = read[first]
            if first != second:
                columns[name] = f"IF(cohort = 1, {read[first]}, {read[second]})"
        selected, version = read["selected_level"], read["version"]
    else:
        columns |= {n: f"CAST({n} AS STRING)" for n in labels if n in plays.columns}
        selected, version = "selected_level", "version"
    if params.selected_level:
        columns["session_level"] = whole_number(selected)
    if any(v is not None for v in params.versions):
        columns["version"] = whole_number(version)
    return plays.selectExpr(*[f"{value} AS {name}" for name, value in columns.items()])


@dataclass(frozen=True)
class UserPlays:
    """Plays per cohort and user under the game and period filter, and who has very many."""

    counts: DataFrame
    hot: HotKeys


def count_users(
    plays: DataFrame,
    params: CompareParams,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    min_rows: int | None = None,
) -> UserPlays:
    """Count plays per user in a pass over the key columns. ``keep`` can set the counts aside."""
    counts = count_keys(tag_cohorts(plays, params).select(*USER), USER)
    if keep is not None:
        counts = keep(counts)
    return UserPlays(counts, list_hot(counts, USER, min_rows))


def active_users(df: DataFrame, users: UserPlays, min_plays: int) -> DataFrame:
    """Plays of users with at least ``min_plays`` plays in the row's cohort."""
    known = df.filter(F.col("user_id").isNotNull())
    if min_plays <= 1:
        return known
    active = users.counts.filter(F.col(ROWS) >= min_plays).select(*USER)
    return filter_by_key(known, active, USER, users.hot, matching=True)


def exclude_users(
    df: DataFrame, users: UserPlays, plays: DataFrame, params: CompareParams
) -> DataFrame:
    """Drop users who ever played the other cohort's game, for the cohorts that ask for it."""
    games = params.game_ids
    others = [
        (cohort, other)
        for cohort, other, wanted in zip(COHORTS, reversed(games), params.exclude_other_game)
        if wanted
    ]
    if not others:
        return df
    cohorts = F.array(*[F.when(F.col("game_id") == game, F.lit(c)) for c, game in others])
    side = (
        plays.filter(F.col("game_id").isin(*{game for _, game in others}))
        .filter(F.col("user_id").isNotNull())
        .select(F.explode(F.array_compact(cohorts)).alias("cohort"), "user_id")
        .distinct()
    )
    return filter_by_key(df, side, USER, users.hot, matching=False)


def age_window(df: DataFrame, params: CompareParams) -> DataFrame:
    """Keep plays whose age lies between the limits of their cohort."""
    if not params.age_unit:
        return df
    old = age(params.age_unit.upper(), "created_at", _as_of(df, params), params.age_boundary)
    lower, upper = (
        per_cohort(dict(zip(COHORTS, pair))) for pair in (params.age_lower, params.age_upper)
    )
    # A wider interval on the bare column, which the file scan can use.
    earliest, latest = _age_limits(df, params)
    return df.filter(f"created_at BETWEEN {earliest} AND {latest}").filter(
        f"{old} BETWEEN {lower} AND {upper}"
    )


def age_partitions(plays: DataFrame, params: CompareParams) -> DataFrame:
    """Leave out months that no wanted age can be in, by the columns that the table is partitioned by.

    The scan then lists only folders of these months. The limits are wider than the age window by two units
    on either side, at least two days, so no time zone of the folders can matter. Tables without
    ``yyyy`` are pruned by ``created_at`` instead, see ``age_window``.
    """
    if not params.age_unit or "yyyy" not in plays.columns:
        return plays
    earliest, latest = _age_limits(plays, params)
    condition = f"CAST(yyyy AS INT) BETWEEN year({earliest}) AND year({latest})"
    if "mm" in plays.columns:
        month = "12 * CAST(yyyy AS INT) + CAST(mm AS INT)"
        first, last = (f"12 * year({end}) + month({end})" for end in (earliest, latest))
        condition += f" AND {month} BETWEEN {first} AND {last}"
    return plays.filter(condition)


def _age_limits(df: DataFrame, params: CompareParams) -> tuple[str, str]:
    """Times between which all wanted plays lie, as constants for the file scan."""
    unit, as_of = params.age_unit.upper(), _as_of(df, params)
    return (
        f"timestampadd({unit}, {-(max(params.age_upper) + 2)}, {as_of})",
        f"timestampadd({unit}, {2 - min(params.age_lower)}, {as_of})",
    )


def _as_of(df: DataFrame, params: CompareParams) -> str:
    kind = _timestamp_type(df)
    return f"{kind}'{params.as_of}'" if params.as_of else f"CAST(current_date() AS {kind})"


def version_filter(df: DataFrame, params: CompareParams) -> DataFrame:
    """Keep the chosen version of each cohort; a cohort without one keeps all its rows."""
    for cohort, version in zip(COHORTS, params.versions):
        if version is not None:
            df = df.filter((F.col("cohort") != cohort) | (F.col("version") == version))
    return df


def session_numbers(
    df: DataFrame, results: DataFrame | None, params: CompareParams
) -> DataFrame:
    """Attach ``nth``, the session number from the results log, where a cohort asks for it.

    The rank runs over all results of the game or games, before any cohort filter. The log is read
    and joined once, whatever the modes of the two cohorts are; plays that are not in it are dropped
    where their cohort needs a number, and rows of the other cohort match nothing and stay. A log that
    has its numbers (``nth_true``, ``nth_cross_game``, see ``ranked_log``) is not ranked again; it has to be
    kept for the games of the cohorts.
    """
    modes = [mode for mode in ("true", "cross_game") if mode in params.numbering]
    if not modes:
        return df
    if results is None:
        raise ValueError("numbering by the results log needs the results table")
    log = results.filter(F.col("game_id").isin(*set(params.game_ids)))
    if all(f"nth_{mode}" in results.columns for mode in modes):
        log = log.selectExpr("id", "game_id", *(f"nth_{mode} AS _{mode}" for mode in modes))
    else:
        log = log.select("id", "game_id", "user_id")
        # Counted once for both modes.
        both = len(modes) > 1
        counts = materialise(count_results(log, ["game_id", "user_id"])) if both else None
        for mode in modes:
            keys = ["user_id"] if mode == "cross_game" else ["game_id", "user_id"]
            log = rank_results(log, keys, f"_{mode}", counts=counts)
    # A number across games belongs to the id alone, the other one to the id in its game.
    entries = [
        f"struct('{mode}' AS _mode, {'game_id' if mode == 'true' else '0L'} AS _game,"
        f" id AS game_result_id, _{mode} AS nth)"
        for mode in modes
    ]
    numbers = log.selectExpr(f"inline(array({', '.join(entries)}))")
    cases = " ".join(f"WHEN {c} THEN '{mode}'" for c, mode in zip(COHORTS, params.numbering))
    wanted = df.selectExpr("*", f"CASE cohort {cases} END AS _mode").selectExpr(
        "*", "IF(_mode = 'true', CAST(game_id AS BIGINT), 0L) AS _game"
    )
    some_observed = "observed" in params.numbering
    joined = wanted.join(
        numbers, ["_mode", "_game", "game_result_id"], "left" if some_observed else "inner"
    )
    if some_observed:
        joined = joined.filter("_mode = 'observed' OR nth IS NOT NULL")
    return joined.drop("_mode", "_game")


def select_cohorts(
    plays: DataFrame,
    params: CompareParams,
    results: DataFrame | None = None,
    users: UserPlays | None = None,
) -> DataFrame:
    """Both cohorts, in one frame. Users are counted first, and the counts set aside."""
    users = count_users(plays, params, materialise) if users is None else users
    tagged = extract_fields(tag_cohorts(age_partitions(plays, params), params), params)
    active = active_users(tagged, users, params.min_plays)
    kept = exclude_users(active, users, plays, params)
    chosen = version_filter(age_window(kept, params), params)
    numbered = session_numbers(chosen, results, params)
    return numbered.select(*[c for c in OUTPUT if c in numbered.columns])
