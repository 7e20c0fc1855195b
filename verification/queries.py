"""The registered queries: one or more per operator, over the whole given tables."""

from __future__ import annotations

import atexit
import contextlib
import datetime
import shutil
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.model import CompareParams
from cohortlens.operators import cleaning as cl
from cohortlens.operators import curves as cv
from cohortlens.operators import distributions as ds
from cohortlens.operators import matrix as mx
from cohortlens.operators import numbering as nb
from cohortlens.operators import ranked_log
from cohortlens.operators import selection as sl
from cohortlens.operators.hotkeys import hot_keys
from cohortlens.plans import metrics as mt
from cohortlens.plans.report import Comparison, compare, empty_cohorts
from cohortlens.session import Workspace, session_workspace, shared_folder
from cohortlens.sources import catalog, sinks, tables
from verification import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BASE = CompareParams(
    game_ids=(1, 2),
    min_plays=5,
    outlier_sigma=2,
    min_level_rows=5,
    min_sessions=5,
    time_sigma=(1.5, 2),
    plot_sigma=8,
    plays_cap=12,
    early_learning=(0.05, 0.3, 8),
    sample_users=40,
)
STRICT = replace(BASE, missing_items=35, min_performance=1)
DATED = CompareParams(game_ids=(11, 12), min_plays=3)
AGED = replace(BASE, age_lower=(3, 1), age_upper=(10, 20), as_of=datetime.date(2024, 1, 31))

# Users with more plays than this are treated as hot in the queries that exercise that path.
FEW_ROWS = 12


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 6 places and times to microseconds, so that both engines can agree; NULL stays."""
    columns = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            columns.append(f"round(`{name}`, 6) as `{name}`")
        elif kind.startswith("timestamp"):
            columns.append(f"unix_micros(cast(`{name}` as timestamp)) as `{name}`")
        elif kind in ("int", "bigint"):
            columns.append(f"cast(`{name}` as bigint) as `{name}`")
        else:
            columns.append(f"`{name}`")
    return df.selectExpr(*columns)


# What queries set aside. It is needed until their results have been read.
_open: list[Workspace | Comparison] = []


def opened(resource):
    _open.append(resource)
    return resource


def workspace(spark: SparkSession) -> Workspace:
    return opened(Workspace(spark))


class Folder:
    """A folder of a query's own in the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def release(self) -> None:
        shutil.rmtree(self.path.removeprefix("file://"), ignore_errors=True)


def folder(spark: SparkSession, name: str) -> str:
    return opened(Folder(spark, name)).path


def release() -> None:
    """Remove what all queries so far have set aside, once their results are read."""
    for resource in _open:
        with contextlib.suppress(Exception):  # the session may have ended
            resource.release()
            if isinstance(resource, Workspace):
                session_workspace(resource.spark).release()
    _open.clear()


atexit.register(release)


# --- sources and sinks -----------------------------------------------------------------------


@query
def scan_plays(spark, sf_dir):
    events = tables.read_plays(spark, f"{sf_dir}/events.parquet")
    return tidy(events.select("event_id", "user_id", "event_type", "ts", "value"))


@query
def scan_results(spark, sf_dir):
    fx.results(spark, sf_dir).createOrReplaceTempView("results_log")
    return tidy(tables.read_results(spark, "results_log"))


@query
def catalog_snapshot(spark, sf_dir):
    snapshot = folder(spark, "games")
    catalog.game_catalog(spark, fx.games(spark, sf_dir), snapshot)
    again = catalog.game_catalog(spark, fx.games(spark, sf_dir).limit(0), snapshot)
    return tidy(again.select("id", "name"))


@query
def refreshed_catalog(spark, sf_dir):
    snapshot = folder(spark, "games")
    games = fx.games(spark, sf_dir)
    catalog.game_catalog(spark, games.withColumn("name", F.upper("name")), snapshot)
    return tidy(catalog.game_catalog(spark, games, snapshot, refresh=True).select("id", "name"))


@query
def cohort_display_names(spark, sf_dir):
    return tidy(catalog.cohort_names(fx.games(spark, sf_dir), (1, 2), ("Old", "New")))


@query
def kept_session_numbers(spark, sf_dir):
    """The results log in four appends: three in the order of ids, and one of late results."""
    path, log = folder(spark, "log"), fx.results(spark, sf_dir)
    n = log.count()
    late = "id % 97 = 5"
    with workspace(spark).current():
        for low, high in ((-1, n // 2), (n // 2, 2 * n // 3), (2 * n // 3, n * n)):
            batch = log.filter(f"id > {low} AND id <= {high} AND NOT ({late})")
            ranked_log.append_results(path, batch, (1, 2))
        ranked_log.append_results(path, log.filter(late), (1, 2))
    return tidy(ranked_log.read_ranked(spark, path))


@query
def true_numbers_by_kept_log(spark, sf_dir):
    """The cohorts of ``true_session_numbers``, with a log that is not ranked again."""
    path, log = folder(spark, "log"), fx.results(spark, sf_dir)
    params = replace(AGED, age_unit="day", numbering=("true", "true"))
    with workspace(spark).current():
        for part in ("id % 2000 < 1000", "id % 2000 >= 1000"):
            ranked_log.append_results(path, log.filter(part), params.game_ids)
        kept = ranked_log.read_ranked(spark, path)
        selected = sl.select_cohorts(fx.plays(spark, sf_dir), params, kept)
    return tidy(selected.select("cohort", "game_result_id", "user_id", "nth"))


@query
def csv_round_trip(spark, sf_dir):
    path = folder(spark, "csv")
    selected = _selected(spark, sf_dir, BASE)
    sinks.write_csv(selected, path)
    return tidy(tables.read_csv(spark, path, selected.schema))


@query
def csv_with_shuffled_columns(spark, sf_dir):
    path = folder(spark, "csv")
    selected = _selected(spark, sf_dir, BASE)
    sinks.write_csv(selected.select(*reversed(selected.columns)), path)
    return tidy(tables.read_csv(spark, path, selected.schema))


RAGGED_SCHEMA = T.StructType().add("user_id", T.LongType()).add("session_level", T.IntegerType()).add("user_level", T.IntegerType())


def _checked(spark, sf_dir):
    path = folder(spark, "ragged")
    fx.ragged_files(spark, sf_dir, path)
    with workspace(spark).current():
        return tables.read_csv_checked(spark, path, RAGGED_SCHEMA)


@query
def csv_united_by_name(spark, sf_dir):
    """Files of one folder with three different headers."""
    rows, _ = _checked(spark, sf_dir)
    return tidy(rows.groupBy("user_id", "session_level", "user_level").agg(F.count("*").alias("n")))


@query
def csv_rejected_lines(spark, sf_dir):
    _, rejected = _checked(spark, sf_dir)
    lines = rejected.withColumn("part", F.regexp_extract("file", r"part=(\d+)", 1).cast("int"))
    return tidy(lines.groupBy("part", "line").agg(F.count("*").alias("n")))


@query
def csv_inferred(spark, sf_dir):
    path = folder(spark, "csv")
    sinks.write_csv(_selected(spark, sf_dir, BASE).select("user_id", "score"), path)
    found = tables.read_csv(spark, path)
    return tidy(found.groupBy("user_id").agg(F.count("score").alias("n")))


@query
def lower_case_columns(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return tables.lower_case(nation.toDF(*[c.upper() for c in nation.columns]))


def _written_report(spark, sf_dir, location):
    """A report that is written twice, as a retried job does."""
    table = _curve(spark, sf_dir, "level_by_session")
    for _ in range(2):
        run_ts = datetime.datetime(2024, 2, 1)
        sinks.write_report({"curves": table}, location, "aVSb", "monthly", run_ts)


@query
def written_report(spark, sf_dir):
    location = folder(spark, "report")
    _written_report(spark, sf_dir, location)
    return tidy(sinks.read_current(spark, location, "aVSb", "monthly")["curves"])


@query
def report_history(spark, sf_dir):
    location = folder(spark, "report")
    _written_report(spark, sf_dir, location)
    return tidy(sinks.read_history(spark, location, "aVSb", "curves"))


# --- selection -------------------------------------------------------------------------------


def _selected(spark, sf_dir, params):
    with workspace(spark).current():
        return sl.select_cohorts(fx.plays(spark, sf_dir), params, fx.results(spark, sf_dir))


def _counted(df: DataFrame) -> DataFrame:
    """Rows and sums per cohort and user: enough to tell two selections apart."""
    return tidy(
        df.groupBy("cohort", "user_id").agg(
            F.count(F.lit(1)).alias("plays"), F.sum("game_result_id").alias("ids")
        )
    )


@query
def json_fields(spark, sf_dir):
    raw = fx.raw_plays(spark, sf_dir)
    return tidy(sl.extract_fields(sl.tag_cohorts(raw, BASE), BASE).drop("game_id"))


@query
def labels_per_cohort(spark, sf_dir):
    raw = fx.raw_plays(spark, sf_dir)
    params = replace(BASE, correct_label=("num_correct", "num_tries"))
    fields = sl.extract_fields(sl.tag_cohorts(raw, params), params)
    return tidy(fields.select("cohort", "game_result_id", "numcorrect"))


@query
def nested_labels(spark, sf_dir):
    """Fields one level down, other ones for the second cohort, and names that differ in case alone."""
    params = replace(
        BASE,
        correct_label=("summary.num_correct", "summary.num_tries"),
        tries_label=("summary.num_tries", "summary.num_correct"),
        playtime_label=("playTime", "playtime"),
    )
    raw = fx.nested_plays(spark, sf_dir)
    fields = sl.extract_fields(sl.tag_cohorts(raw, params), params)
    return tidy(fields.select("cohort", "game_result_id", "numcorrect", "numtries", "playtime"))


@query
def json_paths(spark, sf_dir):
    """Subscripts and quoted names; the elements of the array are of two types."""
    params = replace(
        BASE,
        correct_label=("items[0].x", 'items[2].x["y z"]'),
        tries_label=('items[2]."x"."y z"', "items[0]['x']"),
        playtime_label=('"play.time"."in ms"', "items[1]"),
    )
    raw = fx.listed_plays(spark, sf_dir)
    fields = sl.extract_fields(sl.tag_cohorts(raw, params), params)
    return tidy(fields.select("cohort", "game_result_id", "numcorrect", "numtries", "playtime"))


@query
def json_quoted_names(spark, sf_dir):
    """Names that hold a dot and a blank, without subscripts."""
    names = ('"play.time"."in ms"', "['play.time']['in ms']")
    params = replace(BASE, playtime_label=names)
    raw = fx.listed_plays(spark, sf_dir)
    fields = sl.extract_fields(sl.tag_cohorts(raw, params), params)
    return tidy(fields.select("cohort", "game_result_id", "playtime"))


@query
def selected_level(spark, sf_dir):
    raw = fx.raw_plays(spark, sf_dir)
    params = replace(BASE, selected_level=True)
    fields = sl.extract_fields(sl.tag_cohorts(raw, params), params)
    return tidy(fields.select("cohort", "game_result_id", "session_level"))


@query
def version_per_cohort(spark, sf_dir):
    raw = fx.raw_plays(spark, sf_dir)
    return tidy(sl.select_cohorts(raw, replace(BASE, versions=(1, 2))))


@query
def version_in_one_cohort(spark, sf_dir):
    return _counted(_selected(spark, sf_dir, replace(BASE, versions=(None, 2))))


@query
def game_cohorts(spark, sf_dir):
    return tidy(
        sl.tag_cohorts(fx.plays(spark, sf_dir), BASE).select("cohort", "game_id", "game_result_id")
    )


@query
def year_filter(spark, sf_dir):
    return _counted(sl.select_cohorts(fx.dated(spark, sf_dir), replace(DATED, years=(1996, 1998))))


@query
def year_filter_without_partitions(spark, sf_dir):
    bare = fx.dated(spark, sf_dir).drop("yyyy", "mm")
    return _counted(sl.select_cohorts(bare, replace(DATED, years=(1996, 1998))))


@query
def month_comparison(spark, sf_dir):
    params = replace(DATED, game_ids=(11, 11), months=(3, 4), min_plays=1)
    return _counted(sl.select_cohorts(fx.dated(spark, sf_dir), params))


@query
def age_in_partitions(spark, sf_dir):
    """The same window over a table that is partitioned by year and month: few folders are read."""
    as_of = datetime.date(1998, 8, 31)
    params = replace(DATED, age_unit="month", age_lower=(2, 0), age_upper=(30, 40), as_of=as_of)
    path = folder(spark, "dated")
    spread = fx.dated(spark, sf_dir).repartition("yyyy", "mm")
    spread.write.partitionBy("yyyy", "mm").parquet(path)
    return _counted(sl.select_cohorts(tables.read_plays(spark, path), params))


@query
def overlapping_months(spark, sf_dir):
    params = replace(DATED, game_ids=(11, 11), months=(5, 5), years=(1997,), min_plays=1)
    return _counted(sl.select_cohorts(fx.dated(spark, sf_dir), params))


@query
def age_in_days(spark, sf_dir):
    return _counted(_selected(spark, sf_dir, replace(AGED, age_unit="day")))


@query
def age_in_weeks(spark, sf_dir):
    params = replace(AGED, age_unit="week", age_lower=(1, 0), age_upper=(2, 3))
    return _counted(_selected(spark, sf_dir, params))


@query
def age_in_months(spark, sf_dir):
    as_of = datetime.date(1998, 8, 31)
    params = replace(DATED, age_unit="month", age_lower=(2, 0), age_upper=(30, 40), as_of=as_of)
    return _counted(sl.select_cohorts(fx.dated(spark, sf_dir), params))


@query
def age_in_week_boundaries(spark, sf_dir):
    params = replace(
        AGED, age_unit="week", age_lower=(1, 0), age_upper=(2, 3), age_boundary=True
    )
    return _counted(_selected(spark, sf_dir, params))


@query
def active_users(spark, sf_dir):
    plays = fx.plays(spark, sf_dir)
    users = sl.count_users(plays, BASE)
    return _counted(sl.active_users(sl.tag_cohorts(plays, BASE), users, 12))


@query
def active_users_with_hot_keys(spark, sf_dir):
    plays = fx.plays(spark, sf_dir)
    users = sl.count_users(plays, BASE, min_rows=FEW_ROWS)
    return _counted(sl.active_users(sl.tag_cohorts(plays, BASE), users, 12))


@query
def excluded_users(spark, sf_dir):
    params = replace(DATED, exclude_other_game=(True, False))
    return _counted(sl.select_cohorts(fx.dated(spark, sf_dir), params))


@query
def excluded_users_with_hot_keys(spark, sf_dir):
    params = replace(DATED, exclude_other_game=(True, True), min_plays=1)
    plays = fx.dated(spark, sf_dir)
    users = sl.count_users(plays, params, min_rows=4)
    return _counted(sl.select_cohorts(plays, params, users=users))


@query
def selected_cohorts(spark, sf_dir):
    return tidy(_selected(spark, sf_dir, BASE))


# --- session numbers -------------------------------------------------------------------------


@query
def true_session_numbers(spark, sf_dir):
    params = replace(AGED, age_unit="day", numbering=("true", "true"))
    selected = _selected(spark, sf_dir, params)
    return tidy(selected.select("cohort", "game_result_id", "user_id", "nth"))


@query
def cross_game_session_numbers(spark, sf_dir):
    params = replace(BASE, numbering=("cross_game", "cross_game"))
    selected = _selected(spark, sf_dir, params)
    return tidy(selected.select("cohort", "game_result_id", "user_id", "nth"))


@query
def mixed_session_numbers(spark, sf_dir):
    params = replace(BASE, numbering=("true", "observed"))
    numbered = cl.number_sessions(_selected(spark, sf_dir, params))
    return tidy(numbered.select("cohort", "game_result_id", "user_id", "session_count"))


@query
def cross_game_and_true_session_numbers(spark, sf_dir):
    selected = _selected(spark, sf_dir, replace(BASE, numbering=("cross_game", "true")))
    return tidy(selected.select("cohort", "game_result_id", "user_id", "nth"))


@query
def parameters_from_loose_forms(spark, sf_dir):
    params = CompareParams.create([1, 2], year="all", true_session=True, min_plays=5)
    selected = _selected(spark, sf_dir, params)
    return tidy(selected.select("cohort", "game_result_id", "user_id", "nth"))


RESULT_KEYS = ["game_id", "user_id"]


@query
def result_ranks_with_hot_keys(spark, sf_dir):
    with workspace(spark).current():
        log = fx.results(spark, sf_dir)
        return tidy(nb.rank_results(log, RESULT_KEYS, min_rows=FEW_ROWS))


@query
def anonymous_result_ranks(spark, sf_dir):
    return tidy(nb.rank_results(fx.anonymous_results(spark, sf_dir), RESULT_KEYS))


@query
def anonymous_result_ranks_with_hot_keys(spark, sf_dir):
    with workspace(spark).current():
        log = fx.anonymous_results(spark, sf_dir)
        return tidy(nb.rank_results(log, RESULT_KEYS, min_rows=FEW_ROWS))


def _loaded_twice(spark, sf_dir):
    log = fx.results(spark, sf_dir)
    return log.unionByName(log.filter("id % 2 = 0"))


@query
def repeated_result_ids(spark, sf_dir):
    return tidy(nb.rank_results(_loaded_twice(spark, sf_dir), RESULT_KEYS))


@query
def repeated_result_ids_with_hot_keys(spark, sf_dir):
    with workspace(spark).current():
        return tidy(nb.rank_results(_loaded_twice(spark, sf_dir), RESULT_KEYS, min_rows=FEW_ROWS))


@query
def observed_session_numbers(spark, sf_dir):
    numbered = cl.number_sessions(_selected(spark, sf_dir, BASE))
    return tidy(numbered.select("cohort", "game_result_id", "user_id", "session_count"))


@query
def observed_session_numbers_with_hot_keys(spark, sf_dir):
    selected = _selected(spark, sf_dir, BASE)
    hot = hot_keys(selected, sl.USER, FEW_ROWS)
    numbered = cl.number_sessions(selected, "plays", hot)
    return tidy(numbered.select("cohort", "game_result_id", "user_id", "session_count", "plays"))


# --- cleaning --------------------------------------------------------------------------------


def _staged(spark, sf_dir, params=BASE):
    return workspace(spark).table(_selected(spark, sf_dir, params))


def _typed(spark, sf_dir, params=BASE):
    selected = _staged(spark, sf_dir, params)
    return cl.playtime_seconds(cl.coerce_numbers(cl.drop_null_rows(selected)))


def _cleaned(spark, sf_dir, params=BASE, plays=None):
    """Select and clean as a comparison does: counted users and selected rows are set aside."""
    own = workspace(spark)
    plays, results = plays or fx.plays(spark, sf_dir), fx.results(spark, sf_dir)
    with own.current():
        users = sl.count_users(plays, params, own.table)
        selected = own.table(sl.select_cohorts(plays, params, results, users))
        return cl.clean(selected, params, users.hot).sessions


def _staged_sessions(spark, sf_dir, params=BASE, plays=None):
    return workspace(spark).table(_cleaned(spark, sf_dir, params, plays))


def _ids(df: DataFrame) -> DataFrame:
    return tidy(df.select("cohort", "game_result_id"))


@query
def empty_columns_dropped(spark, sf_dir):
    half = _selected(spark, sf_dir, BASE).withColumn(
        "numtries", F.when(F.col("cohort") == 2, F.col("numtries"))
    )
    return tidy(cl.drop_empty_columns(half))


@query
def null_rows_dropped(spark, sf_dir):
    half = _selected(spark, sf_dir, BASE).withColumn(
        "numtries", F.when(F.col("cohort") == 2, F.col("numtries"))
    )
    return _ids(cl.drop_null_rows(half))


@query
def unparsable_counts(spark, sf_dir):
    return tidy(cl.count_unparsable(cl.drop_null_rows(_selected(spark, sf_dir, BASE))))


@query
def typed_values(spark, sf_dir):
    columns = ("cohort", "game_result_id", "numcorrect", "numtries", "playtime")
    return tidy(_typed(spark, sf_dir).select(*columns))


@query
def missing_items(spark, sf_dir):
    return _ids(cl.missing_items_filter(_typed(spark, sf_dir), 35))


@query
def minimum_performance(spark, sf_dir):
    return _ids(cl.min_performance_filter(_typed(spark, sf_dir), 3))


@query
def sigma_outliers(spark, sf_dir):
    return _ids(cl.sigma_filter(_typed(spark, sf_dir), 1))


@query
def sparse_levels(spark, sf_dir):
    return _ids(cl.sparse_level_filter(_typed(spark, sf_dir), 200))


@query
def unused_tries_dropped(spark, sf_dir):
    zero = _typed(spark, sf_dir).withColumn(
        "numtries", F.when(F.col("cohort") == 1, F.lit(0.0)).otherwise(F.col("numtries"))
    )
    return tidy(cl.drop_unused_tries(zero))


@query
def minimum_sessions(spark, sf_dir):
    return _ids(cl.min_sessions_filter(_typed(spark, sf_dir), 14))


@query
def cleaning_audit(spark, sf_dir):
    return tidy(cl.clean(_staged(spark, sf_dir, STRICT), STRICT).audit)


@query
def cleaned_sessions(spark, sf_dir):
    return tidy(_cleaned(spark, sf_dir, STRICT))


@query
def cleaned_true_sessions(spark, sf_dir):
    return tidy(_cleaned(spark, sf_dir, replace(BASE, numbering=("true", "true"))))


@query
def rows_per_cohort(spark, sf_dir):
    sessions = _staged_sessions(spark, sf_dir)
    missing = empty_cohorts(sessions)
    return tidy(
        sessions.filter(~F.col("cohort").isin(*missing))
        .groupBy("cohort")
        .agg(F.count(F.lit(1)).alias("plays"))
    )


@query
def scores_that_are_no_numbers(spark, sf_dir):
    params = replace(BASE, plot_sigma=0)
    sessions = _staged_sessions(spark, sf_dir, params, fx.plays_with_nan(spark, sf_dir))
    return tidy(mt.curve_tables(sessions, params, ["score_by_level"]))


# --- distributions ---------------------------------------------------------------------------


def _distribution(name: str) -> Query:
    def run(spark, sf_dir):
        sessions = _staged_sessions(spark, sf_dir)
        return tidy(mt.distribution(sessions, BASE, name, workspace(spark).table))

    return run


for _name in mt.distributions():
    QUERIES[_name] = _distribution(_name)


def _all_distributions(spark, sf_dir, params=BASE):
    sessions = _staged_sessions(spark, sf_dir, params)
    return mt.distribution_tables(
        sessions, params, mt.distributions(), workspace(spark).table
    )


@query
def distribution_summaries(spark, sf_dir):
    return tidy(_all_distributions(spark, sf_dir).summary)


@query
def distribution_histograms(spark, sf_dir):
    return tidy(_all_distributions(spark, sf_dir).histograms)


@query
def distribution_tests(spark, sf_dir):
    return tidy(_all_distributions(spark, sf_dir).tests)


@query
def score_tests_sliced(spark, sf_dir):
    users = ds.per_user(_staged_sessions(spark, sf_dir), ["score"])
    values = ds.user_values(users, {"score_per_user": "score"})
    cuts = {"score_per_user": ds.Cut()}
    summary = ds.with_cutoff(users, {"score_per_user": "score"}, cuts)
    counted = ds.user_frequencies(values, summary, cuts)
    staged = workspace(spark).table(counted)
    return tidy(ds.ks_tests(staged, ds.Profile.of(staged), window_rows=0))


@query
def score_tests_asymptotic(spark, sf_dir):
    """As if the samples were too large for an exact p-value."""
    users = ds.per_user(_staged_sessions(spark, sf_dir), ["score"])
    values = ds.user_values(users, {"score_per_user": "score"})
    cuts = {"score_per_user": ds.Cut()}
    summary = ds.with_cutoff(users, {"score_per_user": "score"}, cuts)
    staged = workspace(spark).table(ds.user_frequencies(values, summary, cuts))
    return tidy(ds.ks_tests(staged, ds.Profile.of(staged), exact_rows=1))


@query
def constant_percent_left_out(spark, sf_dir):
    """With as many correct as tries, percent per user is the same for all and gets no test."""
    sessions = _staged_sessions(spark, sf_dir).withColumn("numcorrect", F.col("numtries"))
    names = ["correct_per_user", "percent_per_user"]
    found = mt.distribution_tables(sessions, BASE, names, workspace(spark).table)
    return tidy(found.tests.select("metric", "n1", "n2"))


@query
def infinite_percents(spark, sf_dir):
    return tidy(mt.infinite_percents(_staged_sessions(spark, sf_dir)))


@query
def users_in_long_form(spark, sf_dir):
    users = ds.per_user(_staged_sessions(spark, sf_dir))
    return tidy(users.withColumn("percent", F.expr(ds.PERCENT_PER_USER)))


# --- curves ----------------------------------------------------------------------------------


def _curve(spark, sf_dir, name):
    return mt.curve_tables(_staged_sessions(spark, sf_dir), BASE, [name])


def _curve_query(name: str) -> Query:
    return lambda spark, sf_dir: tidy(_curve(spark, sf_dir, name))


for _name in mt.CURVES:
    QUERIES[_name] = _curve_query(_name)


@query
def all_curves(spark, sf_dir):
    sessions = _staged_sessions(spark, sf_dir)
    return tidy(mt.curve_tables(sessions, BASE, mt.CURVES, workspace(spark).table))


@query
def curves_without_correct(spark, sf_dir):
    sessions = _staged_sessions(spark, sf_dir).drop("numcorrect")
    return tidy(mt.curve_tables(sessions, BASE, mt.CURVES, workspace(spark).table))


@query
def early_score_sliced(spark, sf_dir):
    points = cv.curves(_staged_sessions(spark, sf_dir), "session_count", ["score"])
    staged = workspace(spark).table(points)
    early = cv.early_curves(staged, BASE.early_learning, window_rows=0)
    return tidy(early.select("trim", "cohort", "key", "n", "mean"))


@query
def first_sessions_of_curve(spark, sf_dir):
    points = cv.curves(_staged_sessions(spark, sf_dir), "session_count", ["score"])
    return tidy(cv.first_points(points, 7).select("cohort", "key", "n", "mean"))


@query
def linear_fits(spark, sf_dir):
    points = cv.curves(
        _staged_sessions(spark, sf_dir), "session_level", ["numcorrect", "score"]
    )
    return tidy(cv.linear_fit(points, 0.95))


@query
def linear_fit_bands(spark, sf_dir):
    points = cv.curves(
        _staged_sessions(spark, sf_dir), "session_level", ["numcorrect", "score"]
    )
    return tidy(cv.fit_bands(points, 0.95))


# --- users over sessions ---------------------------------------------------------------------


def _matrix(spark, sf_dir):
    return workspace(spark).table(mx.level_matrix(_staged_sessions(spark, sf_dir), 3))


@query
def level_matrix(spark, sf_dir):
    return tidy(_matrix(spark, sf_dir))


@query
def ordered_users(spark, sf_dir):
    return tidy(mx.ordered_users(_matrix(spark, sf_dir)))


@query
def ordered_users_sliced(spark, sf_dir):
    return tidy(mx.ordered_users(_matrix(spark, sf_dir), window_rows=0))


@query
def user_level_matrix(spark, sf_dir):
    return tidy(mt.user_level_matrix(_staged_sessions(spark, sf_dir), BASE))


@query
def top_users(spark, sf_dir):
    """A sample size just below the smaller cohort, where the step is 1."""
    matrix = _matrix(spark, sf_dir)
    fewest = matrix.groupBy("cohort").count().agg(F.min("count")).first()[0]
    return tidy(mx.sample_users(matrix, fewest - 1))


@query
def level_stops(spark, sf_dir):
    return tidy(mx.level_stops(mx.sample_users(_matrix(spark, sf_dir), BASE.sample_users)))


@query
def jump_by_session(spark, sf_dir):
    return tidy(mt.jump_by_session(_staged_sessions(spark, sf_dir), BASE))


@query
def jump_by_true_session(spark, sf_dir):
    params = replace(BASE, numbering=("cross_game", "cross_game"))
    return tidy(mt.jump_by_session(_staged_sessions(spark, sf_dir, params), params))


# --- the whole comparison --------------------------------------------------------------------


@query
def comparison_without_fits(spark, sf_dir):
    """The curves of a comparison that leaves out the metrics about fit."""
    params = replace(BASE, fit_metrics=False)
    plays, games = fx.plays(spark, sf_dir), fx.games(spark, sf_dir)
    return tidy(opened(compare(spark, plays, params, games=games)).tables["curves"])


@query
def comparison_tests(spark, sf_dir):
    params = replace(BASE, metrics=("plays_per_user", "score_per_user"))
    done = opened(compare(spark, fx.raw_plays(spark, sf_dir), params))
    return tidy(done.tables["distribution_tests"])


@query
def comparison_with_an_empty_cohort(spark, sf_dir):
    """Nobody played game 77: the audit says so, and no metric is computed."""
    done = opened(compare(spark, fx.plays(spark, sf_dir), replace(BASE, game_ids=(1, 77))))
    return tidy(done.tables["audit"].withColumn("skipped", F.lit(done.skipped)))


@query
def recorded_settings(spark, sf_dir):
    done = opened(compare(spark, fx.plays(spark, sf_dir), replace(BASE, metrics=())))
    run = done.tables["run"].select("report", F.explode("settings").alias("name", "value"))
    names = ("game_ids", "min_plays", "numbering", "outlier_sigma", "early_learning", "years")
    return run.filter(F.col("name").isin(*names))


@query
def whole_matrix(spark, sf_dir):
    """All users, unless a sample is asked for."""
    params = replace(BASE, sample_users=None)
    return tidy(mt.user_level_matrix(_staged_sessions(spark, sf_dir), params))
