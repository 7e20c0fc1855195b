import datetime
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import types as T

from cohortlens import CompareParams, compare, compare_and_write
from cohortlens.model import CLEANED, GAMES, PLAYS, RESULTS, SELECTED
from cohortlens.operators import hotkeys, prefix
from cohortlens.operators.selection import select_cohorts
from cohortlens.plans import report
from cohortlens.session import Workspace, constants, lookup, session_workspace, shared_folder
from cohortlens.sources import catalog, sinks, tables
from tests.conftest import rows_of
from verification.queries import QUERIES, release

PARAMS = CompareParams(game_ids=(1, 2), min_plays=5, min_sessions=5, plot_sigma=8)


def games(spark, rows):
    return tables.as_plays(spark.createDataFrame(rows, "id long, name string"), GAMES)


def test_report_has_every_table(spark, skewed_plays):
    names = games(spark, [(1, "Maze"), (2, "Maze two")])
    done = compare(spark, skewed_plays, PARAMS, games=names)
    assert set(done.tables) == {
        *("audit", "unparsable", "run", "cohorts", "distribution_summary", "histograms"),
        *("distribution_tests", "curves", "user_level_matrix", "level_stops"),
        *("jump_by_session", "infinite_percents"),
    }
    assert {r["metric"] for r in done.tables["curves"].collect()} >= {"score_by_level"}
    assert done.tables["distribution_summary"].select("metric").distinct().count() == 10
    run = done.tables["run"].first()
    assert run["settings"]["min_plays"] == "5" and "session_level" in run["plans"]["selected"]
    done.release()


def test_empty_cohort_skips_the_metrics(spark, skewed_plays):
    done = compare(spark, skewed_plays, replace(PARAMS, game_ids=(1, 77)))
    assert "cohort 2" in done.skipped and set(done.tables) == {"audit", "unparsable", "run"}
    done.release()


def test_fewer_columns_fewer_metrics(spark, skewed_plays):
    done = compare(spark, skewed_plays.drop("score", "metadata", "user_level"), PARAMS)
    metrics = {r["metric"] for r in done.tables["curves"].collect()}
    assert metrics == {"level_by_session", "level_by_session_early"}
    assert "jump_by_session" not in done.tables
    done.release()


def test_written_report(spark, skewed_plays, tmp_path):
    params = replace(PARAMS, metrics=("score_by_level",), report="monthly fit")
    location = str(tmp_path / "reports")
    names = games(spark, [(1, "Maze"), (2, "Maze two")])
    for _ in range(2):
        written = compare_and_write(spark, skewed_plays, params, location, games=names)
    assert any("Maze#1VSMazetwo#2" in path for path in written)
    current = sinks.read_current(spark, location, "Maze#1VSMazetwo#2", "monthly fit")["curves"]
    assert current.count() == current.dropDuplicates(["metric", "cohort", "key"]).count() > 0
    history = sinks.read_history(spark, location, "Maze#1VSMazetwo#2", "curves")
    assert history.count() >= current.count()
    assert {r["report"] for r in history.collect()} == {"monthly fit"}


def test_backup_leaves_the_current_copy_alone(spark, tmp_path):
    table = {"t": spark.range(3)}
    run = datetime.datetime(2024, 1, 1)
    written = sinks.write_report(table, str(tmp_path), "f", "r", run, backup_only=True)
    assert all("/history/" in path for path in written)
    assert sinks.read_current(spark, str(tmp_path), "f", "r") == {}
    sinks.write_report(table, str(tmp_path), "f", "r", run + datetime.timedelta(days=1))
    assert sinks.read_current(spark, str(tmp_path), "f", "r")["t"].count() == 3
    assert sinks.read_history(spark, str(tmp_path), "f", "t").count() == 6


def test_report_folder():
    assert sinks.report_folder("A b", "A b") == "Ab"
    assert sinks.report_folder("A b", "C d") == "AbVSCd"


def test_catalog_snapshot(spark, tmp_path):
    path = str(tmp_path / "games")
    first = catalog.game_catalog(spark, games(spark, [(1, "Maze")]), path)
    assert [r["name"] for r in first.collect()] == ["Maze"]
    newer = games(spark, [(1, "Labyrinth")])
    assert catalog.game_catalog(spark, newer, path).first()["name"] == "Maze"
    assert catalog.game_catalog(spark, newer, path, refresh=True).first()["name"] == "Labyrinth"


def test_names_need_exactly_one_match(spark):
    found = catalog.cohort_names(games(spark, [(1, "A"), (1, "B"), (2, "C")]), (1, 2), ("x", ""))
    assert {r["cohort"]: (r["matches"], r["name"]) for r in found.collect()} == {
        1: (2, None),
        2: (1, " C #2"),
    }
    found = catalog.cohort_names(games(spark, [(5, "A")]), (5, 6))
    assert {r["cohort"]: r["matches"] for r in found.collect()} == {1: 1, 2: 0}


def test_csv_keeps_values(spark, skewed_plays, tmp_path):
    path = str(tmp_path / "cohort")
    selected = select_cohorts(skewed_plays, PARAMS)
    sinks.write_csv(selected, path)
    assert rows_of(tables.read_csv(spark, path, selected.schema)) == rows_of(selected)


def test_csv_keeps_microseconds(spark, tmp_path):
    path = str(tmp_path / "times")
    times = spark.sql(
        "SELECT timestamp'2024-01-01 00:00:01.123456' AS a,"
        " timestamp_ntz'2024-01-01 00:00:01.000001' AS b, 'x,\"y\"' AS c"
    )
    sinks.write_csv(times, path)
    assert tables.read_csv(spark, path, times.schema).collect() == times.collect()


def test_read_plays_and_results(spark, skewed_plays, tmp_path):
    path = str(tmp_path / "plays")
    upper = skewed_plays.toDF(*[c.upper() for c in skewed_plays.columns])
    sinks.write_parquet(upper.selectExpr("*", "2024 AS YYYY", "1 AS MM"), path, ("YYYY", "MM"))
    plays = tables.read_plays(spark, path)
    assert set(plays.columns) == {*skewed_plays.columns, "yyyy", "mm"}
    assert tables.as_plays(plays, PLAYS).schema.names == PLAYS.names
    skewed_plays.selectExpr("game_result_id AS id", "*").createOrReplaceTempView("some_log")
    assert tables.read_results(spark, "some_log").columns == RESULTS.names


def test_schemas_agree_with_the_frames(spark, skewed_plays):
    from cohortlens.operators.cleaning import clean

    def types(schema):
        return {f.name: f.dataType.simpleString().replace("_ntz", "") for f in schema}

    selected = select_cohorts(skewed_plays, PARAMS)
    assert types(selected.schema) == types(SELECTED)
    assert types(clean(selected, PARAMS).sessions.schema) == types(CLEANED)


def test_constants(spark):
    rows = [("it's", 1, 0.1, None), ("b\\", -2, 1e-300, True)]
    ddl = "a string, b bigint, c double, d boolean"
    assert [tuple(r) for r in constants(spark, rows, ddl).collect()] == rows
    assert constants(spark, [], ddl).count() == 0
    many = [(str(i), i, i / 7, True) for i in range(700)]
    assert sorted(tuple(r) for r in constants(spark, many, ddl).collect()) == sorted(many)


def test_lookup_broadcasts_only_what_is_small(spark):
    small, large = spark.range(5), spark.range(50)
    assert "broadcast" in lookup(small, 10)._jdf.queryExecution().analyzed().toString()
    assert lookup(large, 10) is large


def files_in_the_shared_folder(spark):
    top = Path(shared_folder(spark).removeprefix("file:"))
    return sorted(str(p) for p in top.rglob("*") if p.is_file())


@pytest.fixture
def nothing_left(spark):
    session_workspace(spark).release()
    release()
    before = files_in_the_shared_folder(spark)
    yield
    session_workspace(spark).release()
    assert files_in_the_shared_folder(spark) == before


def test_comparison_leaves_nothing_behind(spark, skewed_plays, nothing_left):
    with compare(spark, skewed_plays, PARAMS) as done:
        assert done.tables["curves"].count()


def test_failing_comparison_leaves_nothing_behind(spark, skewed_plays, nothing_left, monkeypatch):
    def fail(*_):
        raise RuntimeError("no metrics today")

    monkeypatch.setattr(report.mt, "curve_tables", fail)
    with pytest.raises(RuntimeError, match="no metrics today"):
        compare(spark, skewed_plays, PARAMS)


def test_skewed_comparison_leaves_nothing_behind(spark, skewed_plays, nothing_left, monkeypatch):
    monkeypatch.setattr(hotkeys, "HOT_ROWS", 30)
    monkeypatch.setattr(prefix, "WINDOW_ROWS", 3)
    with compare(spark, skewed_plays, PARAMS) as done:
        assert done.tables["distribution_tests"].count()


@pytest.mark.parametrize("name", ["report_history", "csv_round_trip", "comparison_tests",
                                  "repeated_result_ids_with_hot_keys", "catalog_snapshot"])
def test_registered_query_leaves_nothing_behind(spark, sf_dir, nothing_left, name):
    assert QUERIES[name](spark, sf_dir).count()
    release()


def test_report_can_be_written_again(spark, tmp_path):
    run = datetime.datetime(2024, 1, 1, 0, 0, 0, 5)
    for n in (3, 4):
        sinks.write_report({"t": spark.range(n)}, str(tmp_path), "f", "r", run)
    sinks.write_report({"t": spark.range(2)}, str(tmp_path), "f", "other", run)
    assert sinks.read_current(spark, str(tmp_path), "f", "r")["t"].count() == 4
    assert sinks.read_history(spark, str(tmp_path), "f", "t").count() == 4 + 2


def test_a_killed_write_changes_nothing(spark, tmp_path, monkeypatch):
    """Readers see one whole version: before, while and after another one is written or fails."""
    place, run = str(tmp_path), datetime.datetime(2024, 1, 1)
    sinks.write_report({"a": spark.range(3), "b": spark.range(3)}, place, "f", "r", run)
    before = sinks.read_current(spark, place, "f", "r")
    seen = []

    def sizes():
        return {name: t.count() for name, t in sinks.read_current(spark, place, "f", "r").items()}

    def stop(tables, action, **_):
        """One table is written, then the driver is gone."""
        action("a", tables["a"])
        seen.append(sizes())
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(sinks, "for_each_table", stop)
        with pytest.raises(KeyboardInterrupt):
            sinks.write_report({"a": spark.range(9), "b": spark.range(9)}, place, "f", "r", run)
    assert seen == [{"a": 3, "b": 3}] == [sizes()]
    # A manifest that was being written is no version either.
    (tmp_path / "published/f/99999999999999999999-x/_temporary/0").mkdir(parents=True)
    (tmp_path / "published/f/99999999999999999999-x/_temporary/0/part.json").write_text('{"report": "r"')
    (tmp_path / "published/f/99999999999999999999-y").mkdir()
    (tmp_path / "published/f/99999999999999999999-y/part.json").write_text('{"report": "r", "run": ')
    assert sizes() == {"a": 3, "b": 3}
    sinks.write_report({"a": spark.range(7), "b": spark.range(7)}, place, "f", "r", run)
    assert sizes() == {"a": 7, "b": 7}
    assert {t.count() for t in before.values()} == {3}  # what was opened before is still whole
    assert sinks.read_history(spark, place, "f", "a").count() == 7


def test_names_of_any_kind(spark, tmp_path):
    run = datetime.datetime(2024, 1, 1)
    for n, report in enumerate(["1", "a/b=c%", "é x"], start=1):
        sinks.write_report({"t": spark.range(n), "none": spark.range(0)}, str(tmp_path), "f", report, run)
        current = sinks.read_current(spark, str(tmp_path), "f", report)
        assert current["t"].count() == n and current["none"].columns == ["id"]
    history = sinks.read_history(spark, str(tmp_path), "f", "t")
    assert {r["report"]: r["count"] for r in history.groupBy("report").count().collect()} == {
        "1": 1, "a/b=c%": 2, "é x": 3
    }
    with pytest.raises(ValueError):
        sinks.read_history(spark, str(tmp_path), "g", "t")


def test_csv_columns_go_by_name(spark, tmp_path):
    path = str(tmp_path / "shuffled")
    spark.sql("SELECT 1 AS b, 2 AS A, 3 AS other").coalesce(1).write.option("header", True).csv(path)
    found = tables.read_csv(spark, path, T.StructType.fromDDL("a int, b int, c string"))
    assert found.collect() == [(2, 1, None)]


def test_catalog_columns_can_be_renamed(spark):
    source = spark.sql("SELECT 1L AS Id, 'Maze' AS title, date'2024-01-01' AS launched")
    found = catalog.read_games(source, {"name": "title", "release_date": "launched"})
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in GAMES]
    assert found.first()[:2] == (1, "Maze")


def test_workspace_removes_its_tables(spark):
    workspace = Workspace(spark)
    table = workspace.table(spark.range(9))
    assert table.count() == 9 and table.inputFiles()[0].startswith("file:")
    folder = table.inputFiles()[0]
    workspace.release()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(folder).count()
    assert shared_folder(spark)
