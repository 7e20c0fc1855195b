"""The whole comparison: select, clean, measure, write."""

from __future__ import annotations

import contextlib
import datetime
import io
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.model import COHORTS, CompareParams
from cohortlens.operators import distributions as ds
from cohortlens.operators import matrix as mx
from cohortlens.operators.cleaning import clean
from cohortlens.operators.hotkeys import ROWS
from cohortlens.operators.selection import count_users, select_cohorts
from cohortlens.plans import metrics as mt
from cohortlens.session import Workspace, early_filter
from cohortlens.sources.catalog import cohort_names
from cohortlens.sources.sinks import report_folder, run_record, write_report


@dataclass
class Comparison:
    """Result tables by name, and what is set aside while they are read."""

    tables: dict[str, DataFrame]
    workspace: Workspace
    skipped: str | None = None

    def __enter__(self) -> Comparison:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def release(self) -> None:
        """Free what was set aside, once the tables are written or collected."""
        self.workspace.release()


def empty_cohorts(df: DataFrame) -> list[int]:
    """Cohorts without a row."""
    present = {row["cohort"] for row in df.groupBy("cohort").count().collect()}
    return [c for c in COHORTS if c not in present]


def compare(
    spark: SparkSession,
    plays: DataFrame,
    params: CompareParams,
    results: DataFrame | None = None,
    games: DataFrame | None = None,
    run_ts: datetime.datetime | None = None,
) -> Comparison:
    """All result tables of one comparison.

    The play table is read twice: its key columns to count plays per user, then the cohorts. Selected
    rows and cleaned sessions are written to the shared folder, small aggregates are kept. If the
    comparison fails, everything it set aside is removed.
    """
    workspace = Workspace(spark)
    run_ts = run_ts or datetime.datetime.now(datetime.timezone.utc)
    try:
        with workspace.current():
            return _compare(workspace, plays, params, results, games, run_ts)
    except BaseException:
        workspace.release()
        raise


def plan_text(df: DataFrame) -> str:
    """The plan as ``explain`` prints it."""
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain("extended")
    return text.getvalue()


def _compare(
    workspace: Workspace,
    plays: DataFrame,
    params: CompareParams,
    results: DataFrame | None,
    games: DataFrame | None,
    run_ts: datetime.datetime,
) -> Comparison:
    keep = workspace.keep
    users = count_users(plays, params, workspace.table)
    hot = users.hot
    chosen = select_cohorts(plays, params, results, users)
    active = users.counts.filter(F.col(ROWS) >= params.min_plays).count()
    with early_filter(workspace.spark, active):
        plan = plan_text(chosen)
        selected = workspace.table(chosen)
    typed: list[DataFrame] = []
    cleaned = clean(selected, params, hot, lambda df: typed.append(keep(df)) or typed[-1])
    sessions = workspace.table(cleaned.sessions)
    tables = {
        "audit": keep(cleaned.audit),
        "unparsable": cleaned.unparsable,
        "run": run_record(workspace.spark, params, run_ts, {"selected": plan}),
    }
    tables["audit"].count()
    for frame in typed:
        workspace.free(frame)
    if games is not None:
        tables["cohorts"] = cohort_names(games, params.game_ids, params.labels)

    missing = empty_cohorts(sessions)
    if missing:
        return Comparison(tables, workspace, f"no rows are left in cohort {missing[0]}")

    users_known = None
    if "user_id" in sessions.columns:
        users_known = keep(ds.per_user(sessions))
    found = mt.distribution_tables(sessions, params, mt.distributions(), keep, users_known)
    if found is not None:
        tables["distribution_summary"] = found.summary
        tables["histograms"] = found.histograms
        tables["distribution_tests"] = found.tests
    curves = mt.curve_tables(sessions, params, mt.CURVES, keep)
    if curves is not None:
        tables["curves"] = curves
    wanted = mt.chosen(sessions, params, mt.MATRIX_NEEDS)
    if "user_level_matrix" in wanted:
        matrix = keep(mx.level_matrix(sessions, params.convergence_sessions))
        users = keep(mx.sample_users(matrix, params.sample_users))
        tables["user_level_matrix"] = users
        tables["level_stops"] = mx.level_stops(users)
    if "jump_by_session" in wanted:
        tables["jump_by_session"] = mt.jump_by_session(sessions, params, hot)
    if "numcorrect" in sessions.columns and "numtries" in sessions.columns:
        tables["infinite_percents"] = mt.infinite_percents(sessions, users_known)
    return Comparison(tables, workspace)


def compare_and_write(
    spark: SparkSession,
    plays: DataFrame,
    params: CompareParams,
    location: str,
    results: DataFrame | None = None,
    games: DataFrame | None = None,
    backup_only: bool = False,
) -> list[str]:
    """Run a comparison and write its tables; the folder is named after the two games."""
    run_ts = datetime.datetime.now(datetime.timezone.utc)
    with compare(spark, plays, params, results, games, run_ts) as done:
        names = [str(g) for g in params.game_ids]
        if "cohorts" in done.tables:
            rows = {r["cohort"]: r["name"] for r in done.tables["cohorts"].collect()}
            names = [rows[c] or n for c, n in zip(COHORTS, names)]
        return write_report(
            done.tables, location, report_folder(*names), params.report, run_ts, backup_only
        )
