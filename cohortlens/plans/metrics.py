"""The metrics of a comparison, each a table over the cleaned sessions of both cohorts.

Metrics that share a key share one aggregation: asking for several at once costs about as much
as asking for one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.model import CompareParams
from cohortlens.operators import curves as cv
from cohortlens.operators import distributions as ds
from cohortlens.operators import matrix as mx
from cohortlens.operators.hotkeys import HotKeys

Keep = Callable[[DataFrame], DataFrame]


def _recompute(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Distribution:
    """How a user's (or play's) value is found, and which cut applies to it."""

    needs: tuple[str, ...]
    uses: tuple[str, ...] = ()
    value: str | None = None
    column: str | None = None
    cut: Callable[[CompareParams], ds.Cut] = lambda params: ds.Cut()
    skip_constant: bool = False
    fit: bool = False


@dataclass(frozen=True)
class Curve:
    """A mean of ``measure`` along ``key``; ``early`` restricts it to the first sessions."""

    key: str
    measure: str
    early: bool = False
    fit: bool = False

    @property
    def needs(self) -> tuple[str, ...]:
        return (self.key, *cv.MEASURES[self.measure].needs)


def distributions() -> dict[str, Distribution]:
    def time_cut(params: CompareParams) -> ds.Cut:
        return ds.Cut("mean_sd", params.time_sigma)

    def plot_cut(params: CompareParams) -> ds.Cut:
        return ds.Cut("sd", (params.plot_sigma, params.plot_sigma))

    def plays_cut(params: CompareParams) -> ds.Cut:
        return ds.Cut("cap", (params.plays_cap, params.plays_cap))

    by_user = "user_id"
    return {
        "plays_per_user": Distribution((by_user, "session_count"), ("plays",), "plays"),
        "plays_per_user_capped": Distribution(
            (by_user, "session_count"), ("plays",), "plays", cut=plays_cut
        ),
        "longest_play": Distribution((by_user, "playtime"), ("longest",), "longest", cut=time_cut),
        "shortest_play": Distribution((by_user, "playtime"), ("shortest",), "shortest", cut=time_cut),
        "session_level_plays": Distribution(("session_level",), column="session_level"),
        "user_level_plays": Distribution(("user_level",), column="user_level"),
        "correct_per_user": Distribution((by_user, "numcorrect"), ("correct",), "correct", cut=plot_cut),
        "percent_per_user": Distribution(
            (by_user, "numcorrect", "numtries"),
            ("correct", "tries"),
            ds.PERCENT_PER_USER,
            cut=plot_cut,
            skip_constant=True,
        ),
        "jump_per_user": Distribution(
            (by_user, "user_level", "session_level"), ("jump",), "jump", cut=plot_cut, fit=True
        ),
        "score_per_user": Distribution((by_user, "score"), ("score",), "score", cut=plot_cut),
    }


CURVES = {
    "level_by_session": Curve("session_count", "session_level", fit=True),
    "level_by_session_early": Curve("session_count", "session_level", early=True, fit=True),
    "correct_by_level": Curve("session_level", "numcorrect"),
    "percent_by_level": Curve("session_level", "percent_correct"),
    "correct_by_user_level": Curve("user_level", "numcorrect", fit=True),
    "percent_by_user_level": Curve("user_level", "percent_correct", fit=True),
    "jump_by_level": Curve("session_level", "level_jump", fit=True),
    "score_by_level": Curve("session_level", "score"),
    "score_by_session": Curve("session_count", "score", fit=True),
    "score_by_session_early": Curve("session_count", "score", early=True, fit=True),
}

MATRIX_NEEDS = {
    "user_level_matrix": ("user_id", "session_count", "session_level"),
    "jump_by_session": ("user_id", "event_created_at", "session_level", "user_level"),
}


def chosen(df: DataFrame, params: CompareParams, names: Iterable[str]) -> list[str]:
    """Of ``names``, the metrics that are wanted and whose columns are there (schema only)."""
    known = distributions()
    picked = []
    for name in names:
        if params.metrics is not None and name not in params.metrics:
            continue
        if name in known:
            needs, fit = known[name].needs, known[name].fit
        elif name in CURVES:
            needs, fit = CURVES[name].needs, CURVES[name].fit
        else:
            needs, fit = MATRIX_NEEDS[name], True
        if name == "plays_per_user_capped" and params.plays_cap <= 0:
            continue
        if fit and not params.fit_metrics:
            continue
        if not cv.missing(df, needs):
            picked.append(name)
    return picked


# --- distributions ---------------------------------------------------------------------------


@dataclass(frozen=True)
class DistributionTables:
    summary: DataFrame
    histograms: DataFrame
    tests: DataFrame


def distribution_tables(
    df: DataFrame,
    params: CompareParams,
    names: Iterable[str],
    keep: Keep = _recompute,
    users: DataFrame | None = None,
) -> DistributionTables | None:
    """Summary, histograms and tests of the named distributions.

    ``users`` are the values per user (``operators.distributions.per_user``) if they are known.
    """
    known = distributions()
    names = chosen(df, params, names)
    if not names:
        return None
    cuts = {name: known[name].cut(params) for name in names}
    parts: list[tuple[DataFrame, DataFrame]] = []

    per_user = {n: known[n].value for n in names if known[n].column is None}
    if per_user:
        if users is None:
            used = dict.fromkeys(a for n in per_user for a in known[n].uses)
            users = keep(ds.per_user(df, used))
        values = ds.user_values(users, per_user)
        summary = ds.with_cutoff(users, per_user, cuts)
        parts.append((ds.user_frequencies(values, summary, cuts), summary))
    per_play = {n: known[n].column for n in names if known[n].column is not None}
    if per_play:
        counted = ds.play_frequencies(df, per_play)
        parts.append((counted, ds.play_summary(counted)))

    frequencies, summary = parts[0]
    for more, other in parts[1:]:
        frequencies, summary = frequencies.unionByName(more), summary.unionByName(other)
    frequencies = keep(frequencies)

    profile = ds.Profile.of(frequencies)
    drawn = profile.without(n for n in names if known[n].skip_constant and profile.constant(n))
    return DistributionTables(
        ds.exclusions(frequencies, summary),
        ds.histograms(frequencies, drawn),
        ds.ks_tests(frequencies, drawn),
    )


def distribution(df: DataFrame, params: CompareParams, name: str, keep: Keep = _recompute):
    """One distribution as one table: a row per cohort and bin, with the summary and tests."""
    tables = distribution_tables(df, params, [name], keep)
    if tables is None:
        return None
    return (
        tables.histograms.join(F.broadcast(tables.summary), ["metric", "cohort"])
        .join(F.broadcast(tables.tests), "metric")
    )


def infinite_percents(df: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """How often tries were 0 although something was correct, per user and per play."""
    users = ds.per_user(df, ["correct", "tries"]) if users is None else users
    by_user = (
        users.groupBy("cohort")
        .agg(F.expr("count_if(tries = 0 AND correct > 0)").alias("users"))
    )
    by_play = df.groupBy("cohort").agg(
        F.expr("count_if(numtries = 0 AND numcorrect > 0)").alias("plays")
    )
    return by_play.join(F.broadcast(by_user), "cohort")


# --- curves ----------------------------------------------------------------------------------


def curve_tables(
    df: DataFrame, params: CompareParams, names: Iterable[str], keep: Keep = _recompute
) -> DataFrame | None:
    """The named curves in one table: ``metric, trim, cohort, key, n, mean, ...``.

    One aggregation per key. ``trim`` is NULL for whole curves.
    """
    names = chosen(df, params, names)
    parts = []
    for key in dict.fromkeys(CURVES[n].key for n in names):
        here = {n: CURVES[n] for n in names if CURVES[n].key == key}
        points = keep(cv.curves(df, key, dict.fromkeys(c.measure for c in here.values())))
        whole = {c.measure: n for n, c in here.items() if not c.early}
        early = {c.measure: n for n, c in here.items() if c.early}
        if whole:
            fitted = cv.with_fit(points.filter(F.col("measure").isin(*whole)))
            parts.append(_named(fitted.withColumn("trim", F.lit(None).cast("double")), whole))
        if early and params.early_learning:
            trimmed = cv.early_curves(
                points.filter(F.col("measure").isin(*early)), params.early_learning
            )
            parts.append(_named(cv.with_fit(trimmed, ("measure", "cohort", "trim")), early))
    if not parts:
        return None
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    return combined


def _named(curve: DataFrame, names: dict[str, str]) -> DataFrame:
    cases = " ".join(f"WHEN '{measure}' THEN '{name}'" for measure, name in names.items())
    return curve.selectExpr(
        f"CASE measure {cases} END AS metric",
        *("trim", "cohort", "key", "n", "mean", "stderr", "err", "lo", "hi"),
        "variance_explained",
    )


# --- users over sessions ---------------------------------------------------------------------


def user_level_matrix(df: DataFrame, params: CompareParams) -> DataFrame:
    matrix = mx.level_matrix(df, params.convergence_sessions)
    return mx.sample_users(matrix, params.sample_users)


def jump_by_session(
    df: DataFrame, params: CompareParams, hot: HotKeys | None = None
) -> DataFrame:
    observed = all(mode == "observed" for mode in params.numbering)
    points = mx.jump_by_session(df, params.convergence_sessions, not observed, hot)
    return cv.with_bands(points)


