"""DuckDB SQL for the registered queries, written on its own terms.

Each text repeats the fixture mapping as a CTE. Histograms use range joins on bin edges and the
KS distance a window over distinct values, so a shared mistake would have to be made twice.
"""

from __future__ import annotations

from verification.fixtures import DATED, GAMES, LISTED, PLAYS_DUCKDB, RAGGED

ORACLES: dict[str, str] = {}

PLAYS = f"plays AS ({PLAYS_DUCKDB})"
ORDERS = f"dated AS ({DATED})"

COLUMNS = (
    "cohort, game_result_id, user_id, event_created_at, user_level, session_level, score,"
    " numcorrect, numtries, playtime"
)


def r(column: str, name: str | None = None) -> str:
    return f"round({column}, 6) AS {name or column}"


def us(column: str) -> str:
    return f"epoch_us({column}) AS {column}"


# --- selection -------------------------------------------------------------------------------


def selected(min_plays: int = 5, extra: str = "true") -> str:
    """CTEs up to ``sel``: both cohorts of the play fixture, active users only."""
    return f"""{PLAYS},
    active AS (SELECT game_id, user_id FROM plays WHERE game_id IN (1, 2)
      GROUP BY 1, 2 HAVING count(user_id) >= {min_plays}),
    sel AS (SELECT p.game_id AS cohort, p.* FROM plays p JOIN active USING (game_id, user_id)
      WHERE {extra})"""


def counted(ctes: str, source: str = "sel") -> str:
    return f"""WITH {ctes} SELECT cohort, user_id, count(*) AS plays,
      CAST(sum(game_result_id) AS BIGINT) AS ids FROM {source} GROUP BY 1, 2"""


SELECTED_OUTPUT = (
    "cohort, game_result_id, user_id, epoch_us(event_created_at) AS event_created_at,"
    f" user_level, session_level, {r('score')}, numcorrect, numtries, playtime"
)

ORACLES["scan_plays"] = f"SELECT event_id, user_id, event_type, {us('ts')}, {r('value')} FROM events"
ORACLES["scan_results"] = (
    f"WITH {PLAYS} SELECT game_result_id AS id, game_id, user_id FROM plays"
)
ORACLES["catalog_snapshot"] = f"WITH games AS ({GAMES}) SELECT id, name FROM games"
ORACLES["cohort_display_names"] = f"""WITH games AS ({GAMES})
    SELECT CAST(id AS BIGINT) AS cohort, id AS game_id, 1 AS matches,
      CASE id WHEN 1 THEN 'Old ' ELSE 'New ' END || name || ' #' || id AS name
    FROM games WHERE id IN (1, 2)"""
ORACLES["csv_round_trip"] = f"WITH {selected()} SELECT {SELECTED_OUTPUT} FROM sel"
ORACLES["csv_inferred"] = (
    f"WITH {selected()} SELECT user_id, count(score) AS n FROM sel GROUP BY 1"
)
ORACLES["lower_case_columns"] = "SELECT * FROM nation"
ORACLES["csv_united_by_name"] = f"""WITH {PLAYS},
    rows AS (SELECT user_id, CASE game_result_id % 10 WHEN 4 THEN NULL ELSE session_level END
        AS session_level, CASE game_result_id % 10 WHEN 9 THEN NULL ELSE user_level END AS user_level
      FROM plays WHERE game_result_id % 10 NOT IN (1, 2, 3))
    SELECT user_id, session_level, user_level, count(*) AS n FROM rows GROUP BY ALL"""
ORACLES["csv_rejected_lines"] = f"""WITH {PLAYS}, lines AS ({RAGGED})
    SELECT part, line, count(*) AS n FROM lines WHERE kind IN (1, 2, 3) GROUP BY ALL"""
ORACLES["csv_with_shuffled_columns"] = ORACLES["csv_round_trip"]
ORACLES["refreshed_catalog"] = ORACLES["catalog_snapshot"]
ORACLES["json_fields"] = f"""WITH {PLAYS}
    SELECT game_id AS cohort, game_result_id, user_id, {us('created_at')},
      epoch_us(event_created_at) AS event_created_at, user_level, session_level, {r('score')},
      numcorrect, numtries, playtime FROM plays WHERE game_id IN (1, 2)"""
ORACLES["labels_per_cohort"] = f"""WITH {PLAYS}
    SELECT game_id AS cohort, game_result_id,
      CASE game_id WHEN 1 THEN numcorrect ELSE numtries END AS numcorrect
    FROM plays WHERE game_id IN (1, 2)"""
_NESTED = "CASE game_id WHEN 1 THEN {} ELSE {} END AS {}".format
_BLOB = """json_object('summary', json_object('num_correct', numcorrect, 'num_tries', numtries),
      'playTime', playtime, 'playtime', selected_level)"""


def _path(path: str) -> str:
    return f"json_extract_string(blob, '$.{path}')"


ORACLES["nested_labels"] = f"""WITH {PLAYS},
    blobs AS (SELECT game_id, game_result_id, {_BLOB} AS blob FROM plays WHERE game_id IN (1, 2))
    SELECT game_id AS cohort, game_result_id,
      {_NESTED(_path('summary.num_correct'), _path('summary.num_tries'), 'numcorrect')},
      {_NESTED(_path('summary.num_tries'), _path('summary.num_correct'), 'numtries')},
      {_NESTED(_path('playTime'), _path('playtime'), 'playtime')}
    FROM blobs"""
_LISTED = LISTED.format(
    first="json_object('x', numcorrect)", time="json_object('in ms', playtime)"
)
ORACLES["json_paths"] = f"""WITH {PLAYS},
    blobs AS (SELECT game_id, game_result_id, {_LISTED} AS blob FROM plays WHERE game_id IN (1, 2))
    SELECT game_id AS cohort, game_result_id,
      {_NESTED(_path('items[0].x'), _path('items[2].x."y z"'), 'numcorrect')},
      {_NESTED(_path('items[2].x."y z"'), _path('items[0].x'), 'numtries')},
      {_NESTED(_path('"play.time"."in ms"'), _path('items[1]'), 'playtime')}
    FROM blobs"""
ORACLES["json_quoted_names"] = f"""WITH {PLAYS}
    SELECT game_id AS cohort, game_result_id, playtime FROM plays WHERE game_id IN (1, 2)"""
ORACLES["selected_level"] = f"""WITH {PLAYS}
    SELECT game_id AS cohort, game_result_id, selected_level AS session_level
    FROM plays WHERE game_id IN (1, 2)"""
ORACLES["version_per_cohort"] = (
    f"WITH {selected(extra='version = p.game_id')} SELECT {SELECTED_OUTPUT} FROM sel"
)
ORACLES["version_in_one_cohort"] = counted(selected(extra="p.game_id = 1 OR version = 2"))
ORACLES["game_cohorts"] = f"""WITH {PLAYS}
    SELECT game_id AS cohort, game_id, game_result_id FROM plays WHERE game_id IN (1, 2)"""


def dated_cohorts(first: str, second: str, min_plays: int, keep: tuple[str, str]) -> str:
    """CTEs up to ``sel`` over the dated fixture, one condition per cohort."""
    parts = []
    for cohort, (member, extra) in enumerate(zip((first, second), keep), start=1):
        parts.append(f"""SELECT {cohort} AS cohort, d.* FROM dated d WHERE {member} AND {extra}
          AND user_id IN (SELECT user_id FROM dated WHERE {member} GROUP BY 1
            HAVING count(user_id) >= {min_plays})""")
    return f"{ORDERS}, sel AS ({' UNION ALL '.join(parts)})"


ORACLES["year_filter"] = ORACLES["year_filter_without_partitions"] = counted(
    dated_cohorts(
        "game_id = 11 AND yyyy IN (1996, 1998)",
        "game_id = 12 AND yyyy IN (1996, 1998)",
        3,
        ("true", "true"),
    )
)
ORACLES["month_comparison"] = counted(
    dated_cohorts("game_id = 11 AND mm = 3", "game_id = 11 AND mm = 4", 1, ("true", "true"))
)
ORACLES["overlapping_months"] = counted(
    dated_cohorts(
        "game_id = 11 AND mm = 5 AND yyyy = 1997",
        "game_id = 11 AND mm = 5 AND yyyy = 1997",
        1,
        ("true", "true"),
    )
)


AS_OF = "TIMESTAMP '2024-01-31'"
# DuckDB counts weeks from Thursdays; calendar weeks begin on Monday.
WEEKS = f"""date_diff('day', date_trunc('week', p.created_at), date_trunc('week', {AS_OF})) // 7"""


def complete(unit: str) -> str:
    return f"date_sub('{unit}', p.created_at, {AS_OF})"


def aged(age: str, lower: tuple[int, int], upper: tuple[int, int]) -> str:
    return (
        f"CASE p.game_id WHEN 1 THEN {age} BETWEEN {lower[0]} AND {upper[0]}"
        f" ELSE {age} BETWEEN {lower[1]} AND {upper[1]} END"
    )


ORACLES["age_in_days"] = counted(selected(extra=aged(complete("day"), (3, 1), (10, 20))))
ORACLES["age_in_weeks"] = counted(selected(extra=aged(complete("week"), (1, 0), (2, 3))))
ORACLES["age_in_week_boundaries"] = counted(
    selected(extra=aged(WEEKS, (1, 0), (2, 3)))
)
_MONTHS = "date_sub('month', d.created_at, TIMESTAMP '1998-08-31')"
ORACLES["age_in_months"] = counted(
    dated_cohorts(
        "game_id = 11",
        "game_id = 12",
        3,
        (f"{_MONTHS} BETWEEN 2 AND 30", f"{_MONTHS} BETWEEN 0 AND 40"),
    )
)
ORACLES["age_in_partitions"] = ORACLES["age_in_months"]
ORACLES["active_users"] = ORACLES["active_users_with_hot_keys"] = counted(selected(12))


def not_in_game(game: int) -> str:
    return f"user_id NOT IN (SELECT user_id FROM dated WHERE game_id = {game})"


ORACLES["excluded_users"] = counted(
    dated_cohorts("game_id = 11", "game_id = 12", 3, (not_in_game(12), "true"))
)
ORACLES["excluded_users_with_hot_keys"] = counted(
    dated_cohorts("game_id = 11", "game_id = 12", 1, (not_in_game(12), not_in_game(11)))
)
ORACLES["selected_cohorts"] = ORACLES["csv_round_trip"]


# --- session numbers -------------------------------------------------------------------------

TRUE_NUMBERS = """numbers AS (SELECT game_result_id,
      rank() OVER (PARTITION BY game_id, user_id ORDER BY game_result_id) AS nth FROM plays)"""
CROSS_NUMBERS = """numbers AS (SELECT game_result_id,
      rank() OVER (PARTITION BY user_id ORDER BY game_result_id) AS nth
      FROM plays WHERE game_id IN (1, 2))"""
OBSERVED = (
    "row_number() OVER (PARTITION BY cohort, user_id ORDER BY event_created_at, game_result_id)"
)

ORACLES["true_session_numbers"] = f"""
    WITH {selected(extra=aged(complete('day'), (3, 1), (10, 20)))}, {TRUE_NUMBERS}
    SELECT cohort, game_result_id, user_id, nth FROM sel JOIN numbers USING (game_result_id)"""
ORACLES["true_numbers_by_kept_log"] = ORACLES["true_session_numbers"]
ORACLES["kept_session_numbers"] = f"""WITH {PLAYS}
    SELECT game_result_id AS id, game_id, user_id,
      rank() OVER (PARTITION BY game_id, user_id ORDER BY game_result_id) AS nth_true,
      rank() OVER (PARTITION BY user_id ORDER BY game_result_id) AS nth_cross_game
    FROM plays WHERE game_id IN (1, 2)"""
ORACLES["cross_game_session_numbers"] = f"""WITH {selected()}, {CROSS_NUMBERS}
    SELECT cohort, game_result_id, user_id, nth FROM sel JOIN numbers USING (game_result_id)"""
ORACLES["mixed_session_numbers"] = f"""WITH {selected()}, {TRUE_NUMBERS},
    both_numbers AS (SELECT *, {OBSERVED} AS seen FROM sel JOIN numbers USING (game_result_id))
    SELECT cohort, game_result_id, user_id,
      CASE cohort WHEN 1 THEN nth ELSE seen END AS session_count FROM both_numbers"""
ORACLES["cross_game_and_true_session_numbers"] = f"""WITH {selected()},
    both_numbers AS (SELECT game_result_id, game_id,
      rank() OVER (PARTITION BY user_id ORDER BY game_result_id) AS across,
      rank() OVER (PARTITION BY game_id, user_id ORDER BY game_result_id) AS within
      FROM plays WHERE game_id IN (1, 2))
    SELECT cohort, s.game_result_id, user_id, CASE cohort WHEN 1 THEN across ELSE within END AS nth
    FROM sel s JOIN both_numbers n ON s.game_result_id = n.game_result_id
      AND (cohort = 1 OR s.game_id = n.game_id)"""
ORACLES["parameters_from_loose_forms"] = f"""WITH {selected()}, {TRUE_NUMBERS}
    SELECT cohort, game_result_id, user_id, nth FROM sel JOIN numbers USING (game_result_id)"""
ORACLES["anonymous_result_ranks"] = f"""WITH {PLAYS}, log AS (SELECT game_result_id AS id, game_id,
      CASE WHEN game_result_id % 3 <> 0 THEN user_id END AS user_id FROM plays)
    SELECT id, game_id, user_id, rank() OVER (PARTITION BY game_id, user_id ORDER BY id) AS nth
    FROM log"""
ORACLES["anonymous_result_ranks_with_hot_keys"] = ORACLES["anonymous_result_ranks"]
ORACLES["repeated_result_ids"] = f"""WITH {PLAYS},
    log AS (SELECT game_result_id AS id, game_id, user_id FROM plays
      UNION ALL SELECT game_result_id, game_id, user_id FROM plays WHERE game_result_id % 2 = 0)
    SELECT id, game_id, user_id, rank() OVER (PARTITION BY game_id, user_id ORDER BY id) AS nth
    FROM log"""
ORACLES["repeated_result_ids_with_hot_keys"] = ORACLES["repeated_result_ids"]
ORACLES["result_ranks_with_hot_keys"] = f"""WITH {PLAYS}
    SELECT game_result_id AS id, game_id, user_id,
      rank() OVER (PARTITION BY game_id, user_id ORDER BY game_result_id) AS nth FROM plays"""
ORACLES["observed_session_numbers"] = f"""WITH {selected()}
    SELECT cohort, game_result_id, user_id, {OBSERVED} AS session_count FROM sel"""
ORACLES["observed_session_numbers_with_hot_keys"] = f"""WITH {selected()}
    SELECT cohort, game_result_id, user_id, {OBSERVED} AS session_count,
      count(*) OVER (PARTITION BY cohort, user_id) AS plays FROM sel"""


# --- cleaning --------------------------------------------------------------------------------

COMPLETE = " AND ".join(
    f"{c} IS NOT NULL"
    for c in (
        *("game_result_id", "user_id", "event_created_at", "user_level", "session_level"),
        *("score", "numcorrect", "numtries", "playtime"),
    )
)


def typed(source: str = "sel", nth: bool = False) -> str:
    """CTE ``typed``: complete rows with numbers instead of text."""
    return f"""typed AS (SELECT cohort, game_result_id, user_id, event_created_at, user_level,
      session_level, score, try_cast(numcorrect AS DOUBLE) AS numcorrect,
      try_cast(numtries AS DOUBLE) AS numtries, try_cast(playtime AS DOUBLE) / 1000 AS playtime
      {', nth' if nth else ''} FROM {source} WHERE {COMPLETE})"""


def keep(name: str, source: str, limits: str, drop: str) -> str:
    """CTE ``name``: rows of ``source`` that a limit per cohort does not drop (NULL stays)."""
    return f"""{name} AS (SELECT s.* FROM {source} s JOIN (SELECT cohort, {limits} AS t
      FROM {source} GROUP BY 1) l USING (cohort) WHERE NOT coalesce({drop}, false))"""


def low(name: str, source: str, k: float) -> str:
    limit = f"avg(numcorrect) - {k} * stddev_samp(numcorrect)"
    return keep(name, source, limit, "numcorrect < t")


def high(name: str, source: str, k: float) -> str:
    limit = f"avg(numcorrect) + {k} * stddev_samp(numcorrect)"
    return keep(name, source, limit, "numcorrect > t")


def dense(name: str, source: str, minimum: int) -> str:
    return f"""{name} AS (SELECT * FROM {source} QUALIFY
      count(user_id) OVER (PARTITION BY cohort, session_level) >= {minimum})"""


CHAIN = f"{selected()}, {typed()}, {low('a1', 'typed', 2)}, {high('a2', 'a1', 2)}, " + dense(
    "a3", "a2", 5
)
NUMBERED = f"""numbered AS (SELECT *, {OBSERVED} AS session_count,
      count(*) OVER (PARTITION BY cohort, user_id) AS total FROM a3),
    sessions AS (SELECT * EXCLUDE (total) FROM numbered WHERE total >= 5)"""
SESSIONS = f"{CHAIN}, {NUMBERED}"

STRICT_CHAIN = ", ".join(
    [
        selected(),
        typed(),
        keep("a0", "typed", "max(numtries) - 35", "numtries < t"),
        "a1 AS (SELECT * FROM a0 WHERE NOT coalesce(numcorrect <= 1, false))",
        low("b1", "a1", 2),
        high("b2", "b1", 2),
        dense("a3", "b2", 5),
    ]
)
SESSION_OUTPUT = (
    "cohort, game_result_id, user_id, epoch_us(event_created_at) AS event_created_at,"
    f" user_level, session_level, {r('score')}, {r('numcorrect')}, {r('numtries')},"
    f" {r('playtime')}, session_count"
)


def ids(ctes: str, source: str) -> str:
    return f"WITH {ctes} SELECT cohort, game_result_id FROM {source}"


_HALF = SELECTED_OUTPUT.replace("numtries", "CASE cohort WHEN 2 THEN numtries END AS numtries")
ORACLES["empty_columns_dropped"] = f"""WITH {selected()}
    SELECT {SELECTED_OUTPUT.replace('numtries, ', '')} FROM sel"""
ORACLES["null_rows_dropped"] = f"""WITH {selected()} SELECT cohort, game_result_id FROM sel
    WHERE numcorrect IS NOT NULL AND playtime IS NOT NULL
      AND (cohort = 1 OR numtries IS NOT NULL)"""
ORACLES["unparsable_counts"] = f"""WITH {selected()}
    SELECT cohort, count(*) AS plays,
      count(*) FILTER (WHERE try_cast(numtries AS DOUBLE) IS NULL) AS numtries_unparsable,
      count(*) FILTER (WHERE try_cast(numcorrect AS DOUBLE) IS NULL) AS numcorrect_unparsable
    FROM sel WHERE {COMPLETE} GROUP BY 1"""
ORACLES["typed_values"] = f"""WITH {selected()}, {typed()}
    SELECT cohort, game_result_id, {r('numcorrect')}, {r('numtries')}, {r('playtime')} FROM typed"""
_TYPED = f"{selected()}, {typed()}"
ORACLES["missing_items"] = ids(
    f"{_TYPED}, {keep('x', 'typed', 'max(numtries) - 35', 'numtries < t')}", "x"
)
ORACLES["minimum_performance"] = ids(
    f"{_TYPED}, x AS (SELECT * FROM typed WHERE numcorrect IS NULL OR numcorrect > 3)", "x"
)
ORACLES["sigma_outliers"] = ids(f"{_TYPED}, {low('x', 'typed', 1)}, {high('y', 'x', 1)}", "y")
ORACLES["sparse_levels"] = ids(f"{_TYPED}, {dense('x', 'typed', 200)}", "x")
ORACLES["unused_tries_dropped"] = f"""WITH {_TYPED}
    SELECT {SESSION_OUTPUT.replace(r('numtries') + ',', '').replace(', session_count', '')}
    FROM typed"""
ORACLES["minimum_sessions"] = ids(
    f"""{_TYPED}, x AS (SELECT * FROM typed
      QUALIFY count(*) OVER (PARTITION BY cohort, user_id) >= 14)""",
    "x",
)


def _audit() -> str:
    steps = [
        ("null_rows", "sel", "typed", "NULL"),
        ("missing_items", "typed", "a0", "max(numtries) - 35"),
        ("min_performance", "a0", "a1", "1.0"),
        ("low_outliers", "a1", "b1", "avg(numcorrect) - 2 * stddev_samp(numcorrect)"),
        ("high_outliers", "b1", "b2", "avg(numcorrect) + 2 * stddev_samp(numcorrect)"),
        ("sparse_levels", "b2", "a3", "5.0"),
        ("min_sessions", "a3", "sessions", "5.0"),
    ]
    rows = [
        f"""SELECT b.cohort, {i} AS position, '{step}' AS step, b.n AS rows_before,
          coalesce(a.n, 0) AS rows_after,
          round(CAST(b.t AS DOUBLE), 6) AS threshold
        FROM (SELECT cohort, count(*) AS n, {limit} AS t FROM {before} GROUP BY 1) b
        LEFT JOIN (SELECT cohort, count(*) AS n FROM {after} GROUP BY 1) a USING (cohort)"""
        for i, (step, before, after, limit) in enumerate(steps, start=1)
    ]
    return f"WITH {STRICT_CHAIN}, {NUMBERED} " + " UNION ALL ".join(rows)


ORACLES["cleaning_audit"] = _audit()
ORACLES["cleaned_sessions"] = (
    f"WITH {STRICT_CHAIN}, {NUMBERED} SELECT {SESSION_OUTPUT} FROM sessions"
)
_TRUE_SESSIONS = f"""{selected()}, {TRUE_NUMBERS},
    joined AS (SELECT * FROM sel JOIN numbers USING (game_result_id)), {typed('joined', True)},
    {low('a1', 'typed', 2)}, {high('a2', 'a1', 2)}, {dense('a3', 'a2', 5)},
    sessions AS (SELECT *, nth AS session_count FROM a3
      QUALIFY count(*) OVER (PARTITION BY cohort, user_id) >= 5)"""
ORACLES["cleaned_true_sessions"] = f"WITH {_TRUE_SESSIONS} SELECT {SESSION_OUTPUT} FROM sessions"
ORACLES["rows_per_cohort"] = (
    f"WITH {SESSIONS} SELECT cohort, count(*) AS plays FROM sessions GROUP BY 1"
)


_EMPTY_STEPS = (
    ("null_rows", "sel", "typed", "NULL"),
    ("low_outliers", "typed", "a1", "avg(numcorrect) - 2 * stddev_samp(numcorrect)"),
    ("high_outliers", "a1", "a2", "avg(numcorrect) + 2 * stddev_samp(numcorrect)"),
    ("sparse_levels", "a2", "a3", "5.0"),
    ("min_sessions", "a3", "sessions", "5.0"),
)
ORACLES["comparison_with_an_empty_cohort"] = f"WITH {SESSIONS} " + " UNION ALL ".join(
    f"""SELECT c AS cohort, {i} AS position, '{step}' AS step,
      (SELECT count(*) FROM {before} WHERE cohort = 1 AND c = 1) AS rows_before,
      (SELECT count(*) FROM {after} WHERE cohort = 1 AND c = 1) AS rows_after,
      round(CAST({f"(SELECT {limit} FROM {before} WHERE cohort = 1 AND c = 1)"
        if 'avg' in limit else limit} AS DOUBLE), 6) AS threshold,
      'no rows are left in cohort 2' AS skipped FROM (VALUES (1), (2)) t(c)"""
    for i, (step, before, after, limit) in enumerate(_EMPTY_STEPS, start=1)
)
ORACLES["recorded_settings"] = """SELECT 'comparison' AS report, name, value FROM (VALUES
      ('game_ids', '(1, 2)'), ('min_plays', '5'), ('numbering', '(''observed'', ''observed'')'),
      ('outlier_sigma', '2'), ('early_learning', '(0.05, 0.3, 8)'), ('years', 'None')) t(name, value)"""


# --- distributions ---------------------------------------------------------------------------

PERCENT = """CASE WHEN {b} = 0 AND {a} > 0 THEN 0.0 WHEN {b} = 0 THEN NULL
      ELSE 100 * {a} / {b} END"""
PERCENT_PER_USER = f"round_even({PERCENT.format(a='avg(numcorrect)', b='avg(numtries)')}, 0)"


def _by_user(value: str) -> str:
    return f"SELECT cohort, user_id, CAST({value} AS DOUBLE) AS value FROM sessions GROUP BY 1, 2"


def _by_play(value: str) -> str:
    return f"SELECT cohort, user_id, CAST({value} AS DOUBLE) AS value FROM sessions"


# value, cutoff, condition that keeps a value
VALUES = {
    "plays_per_user": (_by_user("max(session_count)"), "NULL", "true"),
    "plays_per_user_capped": (_by_user("max(session_count)"), "12.0", "value <= cutoff"),
    "longest_play": (
        _by_user("max(playtime)"),
        "mean + CASE cohort WHEN 1 THEN 1.5 ELSE 2 END * sd",
        "value <= cutoff",
    ),
    "shortest_play": (
        _by_user("min(playtime)"),
        "mean + CASE cohort WHEN 1 THEN 1.5 ELSE 2 END * sd",
        "value <= cutoff",
    ),
    "session_level_plays": (_by_play("session_level"), "NULL", "true"),
    "user_level_plays": (_by_play("user_level"), "NULL", "true"),
    "correct_per_user": (_by_user("avg(numcorrect)"), "8 * sd", "value < cutoff"),
    "percent_per_user": (_by_user(PERCENT_PER_USER), "8 * sd", "value < cutoff"),
    "jump_per_user": (_by_user("avg(user_level - session_level)"), "8 * sd", "value < cutoff"),
    "score_per_user": (_by_user("avg(score)"), "8 * sd", "value < cutoff"),
}


def values(names) -> str:
    """CTEs ``vals`` (all), ``summary`` and ``kept`` (after the cut) of the named metrics."""
    parts, limits, keeps = [], "", ""
    for name in names:
        source, cutoff, condition = VALUES[name]
        parts.append(f"SELECT '{name}' AS metric, cohort, value FROM ({source})")
        limits += f" WHEN '{name}' THEN CAST({cutoff} AS DOUBLE)"
        keeps += f" WHEN '{name}' THEN {condition}"
    return f"""vals AS MATERIALIZED ({' UNION ALL '.join(parts)}),
    stats AS (SELECT metric, cohort, count(*) AS total, min(value) AS mn, max(value) AS mx,
      avg(value) AS mean, stddev_samp(value) AS sd FROM vals GROUP BY 1, 2),
    limits AS (SELECT *, CASE metric {limits} END AS cutoff FROM stats),
    kept AS MATERIALIZED (SELECT v.* FROM vals v JOIN limits USING (metric, cohort)
      WHERE value IS NOT NULL AND CASE metric {keeps} END),
    sizes AS MATERIALIZED (SELECT metric, cohort, count(*) AS size, min(value) AS lo,
      max(value) AS hi, sqrt(sum(value * value)) AS norm FROM kept GROUP BY 1, 2)"""


HISTOGRAMS = """spans AS (SELECT metric, min(lo) AS lo, max(hi) AS hi,
      CAST(trunc(max(hi) - min(lo)) AS INT) + 1 AS span FROM sizes GROUP BY 1),
    ranges AS (SELECT s.metric, cohort, size,
      CASE WHEN span < 20 THEN 10 WHEN span < 30 THEN 20 ELSE 30 END AS bins,
      CASE WHEN s.lo = s.hi THEN s.lo - 0.5 ELSE s.lo END AS own_a,
      CASE WHEN s.lo = s.hi THEN s.hi + 0.5 ELSE s.hi END AS own_b,
      CASE WHEN p.lo = p.hi THEN p.lo - 0.5 ELSE p.lo END AS all_a,
      CASE WHEN p.lo = p.hi THEN p.hi + 0.5 ELSE p.hi END AS all_b
      FROM sizes s JOIN spans p USING (metric)),
    bins AS MATERIALIZED (SELECT metric, cohort, size, bin, bins,
      own_a + bin * ((own_b - own_a) / bins) AS own_lo,
      CASE WHEN bin + 1 = bins THEN own_b ELSE own_a + (bin + 1) * ((own_b - own_a) / bins) END
        AS own_hi,
      all_a + bin * ((all_b - all_a) / bins) AS shared_lo,
      CASE WHEN bin + 1 = bins THEN all_b ELSE all_a + (bin + 1) * ((all_b - all_a) / bins) END
        AS shared_hi
      FROM ranges, LATERAL (SELECT unnest(range(CAST(bins AS BIGINT))) AS bin)),
    histograms AS (SELECT b.metric, b.cohort, b.bin, own_lo, own_hi,
      count(*) FILTER (WHERE value >= own_lo AND (value < own_hi OR bin = bins - 1))
        AS own_count,
      shared_lo, shared_hi,
      count(*) FILTER (WHERE value >= shared_lo AND (value < shared_hi OR bin = bins - 1))
        AS shared_count,
      size, all_width FROM (SELECT *, shared_hi - shared_lo AS all_width FROM bins) b
      JOIN kept k ON k.metric = b.metric AND k.cohort = b.cohort
      GROUP BY ALL)"""

KS = """scaled AS (SELECT k.metric, k.cohort, variant,
      CASE variant WHEN 'value' THEN value
        ELSE value / (CASE norm WHEN 0 THEN 1 ELSE CAST(printf('%.11e', norm) AS DOUBLE) END) END
        AS value
      FROM kept k JOIN sizes USING (metric, cohort), (VALUES ('value'), ('shape')) t(variant)),
    counts AS (SELECT metric, variant, value, count(*) FILTER (WHERE cohort = 1) AS c1,
      count(*) FILTER (WHERE cohort = 2) AS c2 FROM scaled GROUP BY 1, 2, 3),
    cdf AS (SELECT metric, variant, sum(c1) OVER w AS f1, sum(c2) OVER w AS f2,
      sum(c1) OVER (PARTITION BY metric, variant) AS n1,
      sum(c2) OVER (PARTITION BY metric, variant) AS n2
      FROM counts WINDOW w AS (PARTITION BY metric, variant ORDER BY value)),
    gaps AS (SELECT metric, variant, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
      max(abs(f1 / n1 - f2 / n2)) AS d, max(abs(f1 * n2 - f2 * n1)) AS gap FROM cdf GROUP BY ALL),
    walk AS (SELECT metric, variant, n1, n2, gap, 0 AS s,
        [CASE WHEN gap > 0 AND i = 0 THEN 1.0::DOUBLE ELSE 0 END for i in range(n1 + 1)] AS inside
      FROM gaps WHERE least(n1, n2) > 0 AND greatest(n1, n2) <= 10000
      UNION ALL SELECT metric, variant, n1, n2, gap, s + 1,
        [CASE WHEN s + 1 - i BETWEEN 0 AND n2 AND abs(i * n2 - (s + 1 - i) * n1) < gap
          THEN inside[i + 1] * (n2 - (s - i)) / (n1 + n2 - s)
            + CASE WHEN i > 0 THEN inside[i] * (n1 - i + 1) / (n1 + n2 - s) ELSE 0 END
          ELSE 0 END for i in range(n1 + 1)]
      FROM walk WHERE s < n1 + n2),
    exact AS (SELECT metric, variant, greatest(0, 1 - inside[n1 + 1]) AS exact_p FROM walk WHERE s = n1 + n2),
    lambdas AS (SELECT *, sqrt(n1 * n2 / (n1 + n2)) AS en FROM gaps),
    ps AS (SELECT *, (en + 0.12 + 0.11 / en) * d AS lam FROM lambdas),
    probabilities AS (SELECT *, CASE WHEN exact_p IS NOT NULL THEN exact_p WHEN lam < 0.2 THEN 1 ELSE least(1, greatest(0,
      2 * list_sum(list_transform(range(1, 101), lambda k:
        (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * lam * lam))))) END AS p,
      CASE WHEN exact_p IS NOT NULL THEN 'exact' ELSE 'asymptotic' END AS method
      FROM ps LEFT JOIN exact USING (metric, variant)),
    tests AS (SELECT v.metric, v.n1, v.n2, v.d, v.p AS p_value, s.d AS shape_d,
      s.p AS shape_p_value, v.p >= 0.05 AS same_distribution, s.p >= 0.05 AS same_shape,
      v.method
      FROM probabilities v JOIN probabilities s ON v.metric = s.metric
        AND v.variant = 'value' AND s.variant = 'shape')"""

_HISTOGRAM_OUTPUT = (
    f"h.metric, h.cohort, h.bin, {r('own_lo')}, {r('own_hi')}, own_count, {r('shared_lo')},"
    f" {r('shared_hi')}, shared_count,"
    f" {r('shared_count / (size * all_width)', 'density')}"
)
_SUMMARY_OUTPUT = (
    f"total, total - coalesce(size, 0) AS excluded, {r('mn', 'min')}, {r('mx', 'max')},"
    f" {r('mean')}, {r('cutoff')}"
)
_TEST_OUTPUT = (
    f"n1, n2, {r('d')}, {r('p_value')}, {r('shape_d')}, {r('shape_p_value')},"
    " same_distribution, same_shape, method"
)

for _name in VALUES:
    ORACLES[_name] = f"""WITH RECURSIVE {SESSIONS}, {values([_name])}, {HISTOGRAMS}, {KS}
    SELECT {_HISTOGRAM_OUTPUT}, {_SUMMARY_OUTPUT.replace('coalesce(size, 0)', 'size')},
      {_TEST_OUTPUT}
    FROM histograms h JOIN limits l USING (metric, cohort) JOIN tests t USING (metric)"""

ORACLES["distribution_summaries"] = f"""WITH {SESSIONS}, {values(VALUES)}
    SELECT metric, cohort, {_SUMMARY_OUTPUT}
    FROM limits LEFT JOIN sizes USING (metric, cohort)"""
ORACLES["distribution_histograms"] = f"""WITH {SESSIONS}, {values(VALUES)}, {HISTOGRAMS}
    SELECT {_HISTOGRAM_OUTPUT} FROM histograms h"""
ORACLES["distribution_tests"] = f"""WITH RECURSIVE {SESSIONS}, {values(VALUES)}, {KS}
    SELECT metric, {_TEST_OUTPUT} FROM tests"""
ORACLES["score_tests_sliced"] = f"""WITH RECURSIVE {SESSIONS},
    {values(['score_per_user']).replace('value < cutoff', 'true')}, {KS}
    SELECT metric, {_TEST_OUTPUT} FROM tests"""
ORACLES["score_tests_asymptotic"] = ORACLES["score_tests_sliced"].replace("<= 10000", "<= 1")
ORACLES["comparison_tests"] = f"""WITH RECURSIVE {SESSIONS},
    {values(['plays_per_user', 'score_per_user'])}, {KS} SELECT metric, {_TEST_OUTPUT} FROM tests"""
ORACLES["constant_percent_left_out"] = f"""WITH {SESSIONS},
    users AS (SELECT cohort, avg(numtries) AS value FROM sessions GROUP BY cohort, user_id),
    limits AS (SELECT cohort, 8 * stddev_samp(value) AS cutoff FROM users GROUP BY 1)
    SELECT 'correct_per_user' AS metric, count(*) FILTER (WHERE cohort = 1) AS n1,
      count(*) FILTER (WHERE cohort = 2) AS n2
    FROM users JOIN limits USING (cohort) WHERE value < cutoff"""
ORACLES["infinite_percents"] = f"""WITH {SESSIONS},
    u AS (SELECT cohort, avg(numtries) AS t, avg(numcorrect) AS c FROM sessions
      GROUP BY cohort, user_id)
    SELECT cohort, plays, users FROM
      (SELECT cohort, count(*) FILTER (WHERE numtries = 0 AND numcorrect > 0) AS plays
       FROM sessions GROUP BY 1)
      JOIN (SELECT cohort, count(*) FILTER (WHERE t = 0 AND c > 0) AS users FROM u GROUP BY 1)
      USING (cohort)"""
ORACLES["users_in_long_form"] = f"""WITH {SESSIONS}
    SELECT cohort, user_id, max(session_count) AS plays, {r('max(playtime)', 'longest')},
      {r('min(playtime)', 'shortest')}, {r('avg(numcorrect)', 'correct')},
      {r('avg(numtries)', 'tries')}, {r('avg(user_level - session_level)', 'jump')},
      {r('avg(score)', 'score')}, {r(PERCENT_PER_USER, 'percent')}
    FROM sessions GROUP BY 1, 2"""


# --- curves ----------------------------------------------------------------------------------

ROW_PERCENT = PERCENT.format(a="numcorrect", b="numtries")
# metric: key, row value, plotted mean, early
CURVES = {
    "level_by_session": ("session_count", "session_level", None, False),
    "level_by_session_early": ("session_count", "session_level", None, True),
    "correct_by_level": ("session_level", "numcorrect", None, False),
    "percent_by_level": ("session_level", ROW_PERCENT, None, False),
    "correct_by_user_level": ("user_level", "numcorrect", None, False),
    "percent_by_user_level": ("user_level", ROW_PERCENT, None, False),
    "jump_by_level": (
        "session_level",
        "user_level - session_level",
        "avg(user_level) - avg(session_level)",
        False,
    ),
    "score_by_level": ("session_level", "score", None, False),
    "score_by_session": ("session_count", "score", None, False),
    "score_by_session_early": ("session_count", "score", None, True),
}
FIT = """CASE WHEN stddev_pop(key) OVER g = 0 OR stddev_pop(fit) OVER g = 0 THEN NULL
      ELSE 100 * pow(covar_pop(key, fit) OVER g / (stddev_pop(key) OVER g * stddev_pop(fit) OVER g), 2)
      END"""


def points(key: str, value: str, mean: str | None = None, source: str = "sessions") -> str:
    """A derived table of curve points."""
    return f"""(SELECT cohort, {key} AS key, count({value}) AS n, {mean or f'avg({value})'} AS mean,
      stddev_samp({value}) / sqrt(count({value})) AS stderr, avg({value}) AS fit
      FROM {source} GROUP BY 1, 2 HAVING count({value}) > 0)"""


def curve(name: str, source: str = "sessions") -> str:
    key, value, mean, early = CURVES[name]
    trims = "(VALUES (NULL::DOUBLE)) t(trim)"
    keep_point = "true"
    if early:
        trims = "(VALUES (0.05::DOUBLE), (0.3::DOUBLE), (8::DOUBLE)) t(trim)"
        keep_point = """CASE WHEN trim <= 1 THEN plays < total * (1 - trim)
          ELSE place <= trim END"""
    return f"""SELECT '{name}' AS metric, {r('trim')}, cohort, key, n, {r('mean')}, {r('stderr')},
      coalesce(round(stderr, 6), 0) AS err, {r('mean - stderr', 'lo')},
      {r('mean + stderr', 'hi')}, round({FIT}, 6) AS variance_explained
    FROM (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY cohort ORDER BY key) AS plays,
        sum(n) OVER (PARTITION BY cohort) AS total,
        row_number() OVER (PARTITION BY cohort ORDER BY key) AS place
        FROM {points(key, value, mean, source)}), {trims} WHERE {keep_point})
    WINDOW g AS (PARTITION BY cohort, trim)"""


for _name in CURVES:
    ORACLES[_name] = f"WITH {SESSIONS} {curve(_name)}"
ORACLES["written_report"] = f"""WITH {SESSIONS}, c AS ({curve('level_by_session')})
    SELECT * FROM c"""
ORACLES["report_history"] = f"""WITH {SESSIONS}, c AS ({curve('level_by_session')})
    SELECT *, 'monthly' AS report, '20240201T000000_000000' AS run FROM c"""
ORACLES["scores_that_are_no_numbers"] = (f"WITH {SESSIONS} {curve('score_by_level')}").replace(
    "value as score", "case when k <> 11 then value end as score"
)
ORACLES["curves_without_correct"] = f"WITH {SESSIONS} " + " UNION ALL ".join(
    f"SELECT * FROM ({curve(n)})" for n in CURVES if "numcorrect" not in CURVES[n][1]
)
ORACLES["all_curves"] = f"WITH {SESSIONS} " + " UNION ALL ".join(
    f"SELECT * FROM ({curve(n)})" for n in CURVES
)
_NO_FIT = ("correct_by_level", "percent_by_level", "score_by_level")
ORACLES["comparison_without_fits"] = f"WITH {SESSIONS} " + " UNION ALL ".join(
    f"SELECT * FROM ({curve(n)})" for n in _NO_FIT
)
ORACLES["early_score_sliced"] = f"""WITH {SESSIONS}, c AS ({curve('score_by_session_early')})
    SELECT trim, cohort, key, n, mean FROM c"""
ORACLES["first_sessions_of_curve"] = f"""WITH {SESSIONS}
    SELECT cohort, key, n, {r('mean')} FROM {points('session_count', 'score')} AS p
    QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY key) <= 7"""

_FITS = f"""lines AS (
      SELECT 'numcorrect' AS measure, * FROM {points('session_level', 'numcorrect')} AS a
      UNION ALL SELECT 'score', * FROM {points('session_level', 'score')} AS b),
    coefficients AS (SELECT measure, cohort, count(*) AS points, regr_slope(fit, key) AS slope,
      regr_intercept(fit, key) AS intercept, avg(key) AS mean_x, var_pop(fit) AS variance,
      sum(key * key) - count(*) * avg(key) * avg(key) AS sxx FROM lines GROUP BY 1, 2),
    residuals AS (SELECT measure, cohort, sum(pow(fit - intercept - slope * key, 2)) AS rss
      FROM lines JOIN coefficients USING (measure, cohort) GROUP BY 1, 2)"""
# Published quantiles of Student's t at 0.975 for 1 to 10 degrees of freedom.
_TABLED = """tabled AS (SELECT * FROM (VALUES (1, 12.706204736174698), (2, 4.302652729749462),
      (3, 3.182446305283708), (4, 2.776445105197793), (5, 2.570581835636314), (6, 2.446911851144969),
      (7, 2.364624251592785), (8, 2.306004135204166), (9, 2.262157162798205), (10, 2.228138851986274))
      AS t(freedom, t_value))"""
ORACLES["linear_fits"] = f"""WITH {SESSIONS}, {_FITS}, {_TABLED}
    SELECT measure, cohort, points, {r('slope')}, {r('intercept')}, {r('mean_x')}, {r('sxx')},
      {r('sqrt(rss / (points - 2))', 'residual_sd')},
      {r('rss / (variance * variance)', 'chi_square')},
      {r('rss / (variance * variance) / (points - 2)', 'reduced_chi_square')}, {r('t_value')}
    FROM coefficients JOIN residuals USING (measure, cohort) LEFT JOIN tabled ON freedom = points - 2"""
ORACLES["linear_fit_bands"] = f"""WITH {SESSIONS}, {_FITS}, {_TABLED},
    ends AS (SELECT measure, cohort, min(key) AS a, max(key) AS b FROM lines GROUP BY 1, 2),
    xs AS (SELECT *, a + point * ((b - a) / 99) AS x
      FROM ends, (SELECT unnest(range(100)) AS point)),
    bands AS (SELECT *, intercept + slope * x AS fitted,
      1 / points + (x - mean_x) * (x - mean_x) / sxx AS h,
      t_value * sqrt(rss / (points - 2)) AS w
      FROM xs JOIN coefficients USING (measure, cohort) JOIN residuals USING (measure, cohort)
      LEFT JOIN tabled ON freedom = points - 2)
    SELECT measure, cohort, point, {r('x')}, {r('fitted')},
      {r('fitted - w * sqrt(h)', 'confidence_lo')}, {r('fitted + w * sqrt(h)', 'confidence_hi')},
      {r('fitted - w * sqrt(1 + h)', 'prediction_lo')},
      {r('fitted + w * sqrt(1 + h)', 'prediction_hi')} FROM bands"""


# --- users over sessions ---------------------------------------------------------------------

MATRIX = """matrix AS MATERIALIZED (SELECT cohort, user_id,
      max(session_level) FILTER (WHERE session_count = 1) AS s1,
      max(session_level) FILTER (WHERE session_count = 2) AS s2,
      max(session_level) FILTER (WHERE session_count = 3) AS s3
      FROM sessions GROUP BY 1, 2
      HAVING bool_or(session_count = 1) AND bool_or(session_count = 2)
        AND bool_or(session_count = 3)),
    ordered AS (SELECT *,
      row_number() OVER (PARTITION BY cohort ORDER BY s1, s2, s3, user_id) - 1 AS ordinal,
      count(*) OVER (PARTITION BY cohort) AS users FROM matrix)"""


def sampled(most: str) -> str:
    """CTE ``sampled``: positions step, 2 step, ... of the (tail of the) ordered users."""
    return f"""steps AS (SELECT *, {most} AS most,
      CASE WHEN users > {most} THEN CAST(round_even(users / {most}, 0) AS BIGINT) END AS step
      FROM ordered),
    tails AS (SELECT *, CASE WHEN step = 1 THEN ordinal - users + most ELSE ordinal END AS place
      FROM steps),
    sampled AS (SELECT cohort, user_id, s1, s2, s3, ordinal,
      CASE WHEN step IS NULL THEN 'all' WHEN step = 1 THEN 'top' ELSE 'downsampled' END AS sample
      FROM tails
      WHERE step IS NULL OR place IN (SELECT unnest(range(step, step * most, step))))"""


ORACLES["level_matrix"] = (
    f"WITH {SESSIONS}, {MATRIX} SELECT cohort, user_id, s1, s2, s3 FROM matrix"
)
ORACLES["ordered_users"] = ORACLES["ordered_users_sliced"] = (
    f"WITH {SESSIONS}, {MATRIX} SELECT cohort, user_id, s1, s2, s3, ordinal FROM ordered"
)
ORACLES["whole_matrix"] = f"""WITH {SESSIONS}, {MATRIX}
    SELECT cohort, user_id, s1, s2, s3, ordinal, 'all' AS sample FROM ordered"""
ORACLES["user_level_matrix"] = (
    f"WITH {SESSIONS}, {MATRIX}, {sampled('40')} SELECT * FROM sampled"
)
_FEWEST = "(SELECT min(users) - 1 FROM ordered)"
ORACLES["top_users"] = (
    f"WITH {SESSIONS}, {MATRIX}, {sampled(_FEWEST)} SELECT * FROM sampled"
)
ORACLES["level_stops"] = f"""WITH {SESSIONS}, {MATRIX}, {sampled('40')},
    ends AS (SELECT cohort, min(least(s1, s2, s3)) AS a, max(greatest(s1, s2, s3)) AS b
      FROM sampled GROUP BY 1)
    SELECT cohort, stop, {r('a + stop * ((b - a) / 11)', 'level')}
    FROM ends, (SELECT unnest(range(12)) AS stop)"""


def _jumps(sessions: str, number: str) -> str:
    return f"""WITH {sessions}, jumps AS (SELECT cohort, {number} - 1 AS key,
      user_level - session_level AS jump FROM sessions),
    firsts AS (SELECT * FROM jumps WHERE key < 3),
    ends AS (SELECT cohort, min(jump) AS lowest_jump, max(jump) AS highest_jump
      FROM firsts GROUP BY 1),
    curve AS (SELECT cohort, key, count(*) AS n, avg(jump) AS mean, stddev_samp(jump) AS sd,
      stddev_samp(jump) / sqrt(count(*)) AS stderr FROM firsts GROUP BY 1, 2)
    SELECT cohort, key, n, {r('mean')}, {r('sd')}, lowest_jump, highest_jump, {r('stderr')},
      coalesce(round(stderr, 6), 0) AS err, {r('mean - stderr', 'lo')},
      {r('mean + stderr', 'hi')} FROM curve JOIN ends USING (cohort)"""


ORACLES["jump_by_session"] = _jumps(SESSIONS, "session_count")
ORACLES["jump_by_true_session"] = _jumps(
    _TRUE_SESSIONS.replace(TRUE_NUMBERS, CROSS_NUMBERS), OBSERVED
)
del _name
