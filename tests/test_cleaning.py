from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortlens.model import SELECTED, CompareParams
from cohortlens.operators import cleaning as cl
from cohortlens.operators import hotkeys
from tests.conftest import rows_of

PARAMS = CompareParams(game_ids=(1, 2), min_level_rows=-1, min_sessions=1)
DDL = "cohort int, user_id long, numcorrect double, numtries double, session_level int"


def frame(spark, rows, ddl=DDL):
    return spark.createDataFrame(rows, ddl)


def correct(df):
    return sorted((r["numcorrect"] for r in df.collect()), key=lambda v: (v is None, v))


def test_filters_keep_null(spark):
    df = frame(spark, [(1, 1, v, t, 1) for v, t in [(1.0, 9.0), (None, None), (8.0, 1.0)]])
    assert correct(cl.min_performance_filter(df, 2)) == [8.0, None]
    assert correct(cl.missing_items_filter(df, 3)) == [1.0, None]
    assert None in correct(cl.sigma_filter(df, 0.5))


def test_switched_off_filters_change_nothing(spark):
    df = frame(spark, [(1, 1, 1.0, 9.0, 1), (1, 1, 50.0, 0.0, 2)])
    for filtered in (
        cl.missing_items_filter(df, 0),
        cl.min_performance_filter(df, 0),
        cl.sigma_filter(df, 0),
        cl.sparse_level_filter(df, -1),
    ):
        assert filtered.count() == 2


def test_second_sigma_pass_uses_the_survivors(spark):
    values = [-100.0, 10.0, 11.0, 12.0, 10.0, 11.0, 12.0, 10.0, 11.0, 40.0]
    df = frame(spark, [(1, i, v, 1.0, 1) for i, v in enumerate(values)])
    mean = sum(values) / len(values)
    sd = (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5
    one_pass = [v for v in values if mean - 2 * sd <= v <= mean + 2 * sd]
    assert 40.0 in one_pass and -100.0 not in one_pass
    assert 40.0 not in correct(cl.sigma_filter(df, 2))


def test_thresholds_belong_to_a_cohort(spark):
    df = frame(spark, [(1, 1, 1.0, 50.0, 1), (1, 1, 2.0, 10.0, 1), (2, 1, 3.0, 10.0, 1)])
    assert correct(cl.missing_items_filter(df, 5)) == [1.0, 3.0]


def test_sparse_levels_by_cohort(spark):
    rows = [(1, i, 1.0, 1.0, 1) for i in range(5)] + [(2, i, 2.0, 1.0, 1) for i in range(4)]
    kept = cl.sparse_level_filter(frame(spark, rows), 5)
    assert {r["cohort"] for r in kept.collect()} == {1}


def test_sparse_levels_without_broadcast(spark, monkeypatch):
    rows = [(1, i, 1.0, 1.0, i % 9) for i in range(50)] + [(1, 0, 1.0, 1.0, 90)]
    selected = frame(spark, rows).withColumns(
        {"game_result_id": F.monotonically_increasing_id(), "event_created_at": F.lit(1)}
    )
    params = replace(PARAMS, min_level_rows=5)
    expected = cl.clean(selected, params).sessions.count()
    monkeypatch.setattr(cl, "BROADCAST_ROWS", 2)
    assert cl.clean(selected, params).sessions.count() == expected == 45 + 5


def test_popular_levels_are_spread(spark, monkeypatch):
    """Above the broadcast limit a level with a third of all plays is salted, and counts stay the same."""
    rows = [(1 + i % 2, i, 1.0, 1.0, 7 if i % 3 == 0 else i % 40) for i in range(600)]
    selected = frame(spark, rows).withColumns(
        {"game_result_id": F.monotonically_increasing_id(), "event_created_at": F.lit(1)}
    )
    for minimum, some_left in ((12, True), (150, False)):
        params = replace(PARAMS, min_level_rows=minimum)
        expected = cl.clean(selected, params)
        expected = rows_of(expected.sessions), rows_of(expected.audit)
        with monkeypatch.context() as patched:
            patched.setattr(cl, "BROADCAST_ROWS", 2)
            patched.setattr(hotkeys, "HOT_ROWS", 50)
            found = cl.clean(selected, params)
            plan = found.sessions._jdf.queryExecution().optimizedPlan().toString()
            assert hotkeys.SALT in plan
            assert (rows_of(found.sessions), rows_of(found.audit)) == expected
        assert (0 < len(expected[0]) < 600) == some_left


def test_tries_left_are_looked_up_with_many_levels(spark, monkeypatch):
    """Whether any try is left comes from the counted levels: only the sparse level has one."""
    rows = [(c, i, 1.0, 0.0, i % 3) for c in (1, 2) for i in range(30)] + [(1, 0, 1.0, 4.0, 90)]
    selected = frame(spark, rows).withColumns(
        {"game_result_id": F.monotonically_increasing_id(), "event_created_at": F.lit(1)}
    )
    params = replace(PARAMS, min_level_rows=5)
    expected = cl.clean(selected, params).sessions
    assert "numtries" not in expected.columns
    monkeypatch.setattr(cl, "BROADCAST_ROWS", 2)
    found = cl.clean(selected, params).sessions
    assert found.columns == expected.columns and rows_of(found) == rows_of(expected)


def test_column_empty_in_one_cohort(spark):
    rows = [(1, 1, 1.0, None, 1), (1, 2, None, None, 1), (2, 1, 1.0, 5.0, 1), (2, 2, 1.0, None, 1)]
    df = frame(spark, rows)
    # Cohort 1 never has numtries, so only its other NULL counts; cohort 2 has one.
    kept = cl.drop_null_rows(df)
    assert sorted((r["cohort"], r["user_id"]) for r in kept.collect()) == [(1, 1), (2, 1)]
    assert "numtries" not in cl.drop_empty_columns(df).columns


def test_unparsable_values_are_counted_and_kept(spark):
    rows = [(1, "3", "4"), (1, "bad", "4"), (1, None, "x"), (2, "1", "2")]
    df = frame(spark, rows, "cohort int, numcorrect string, numtries string")
    counts = {r["cohort"]: r for r in cl.count_unparsable(df).collect()}
    assert counts[1]["numcorrect_unparsable"] == 1 and counts[1]["numtries_unparsable"] == 1
    assert counts[2]["numcorrect_unparsable"] == 0
    assert cl.coerce_numbers(df).count() == 4


def test_playtime_is_divided_exactly(spark):
    df = frame(spark, [(1, "1500"), (1, "x")], "cohort int, playtime string")
    assert [r["playtime"] for r in cl.playtime_seconds(df).collect()] == [1.5, None]


def test_tries_that_never_count_are_dropped(spark):
    zero = frame(spark, [(1, 1, 1.0, 0.0, 1), (2, 1, 1.0, 5.0, 1)])
    assert "numtries" not in cl.drop_unused_tries(zero).columns
    unknown = frame(spark, [(1, 1, 1.0, None, 1), (2, 1, 1.0, 5.0, 1)])
    assert "numtries" in cl.drop_unused_tries(unknown).columns


def test_tied_times_are_numbered_by_result(spark):
    rows = [(1, 7, 1, 30), (1, 7, 1, 10), (1, 7, 1, 20), (1, 7, 0, 99)]
    df = frame(spark, rows, "cohort int, user_id long, event_created_at int, game_result_id long")
    numbered = cl.number_sessions(df).collect()
    assert {r["game_result_id"]: r["session_count"] for r in numbered} == {99: 1, 10: 2, 20: 3, 30: 4}


def test_numbers_from_the_results_log_win(spark):
    rows = [(1, 7, 1, 30, 5), (2, 7, 1, 10, None)]
    ddl = "cohort int, user_id long, event_created_at int, game_result_id long, nth long"
    numbered = cl.number_sessions(frame(spark, rows, ddl))
    assert sorted(r["session_count"] for r in numbered.collect()) == [1, 5]
    assert "nth" not in numbered.columns


def selected(spark, rows):
    """(cohort, result, user, minute, level, correct, tries, playtime) to selected rows."""
    made = [
        (c, result, user, None, level, level, 1.0, correct_, tries, playtime)
        for c, result, user, _, level, correct_, tries, playtime in rows
    ]
    df = spark.createDataFrame(made, SELECTED)
    return df.withColumn("event_created_at", F.expr("timestamp_seconds(game_result_id)"))


def test_chain_and_audit(spark):
    rows = [(1, i, i % 3, i, 1 + i % 2, str(i), "20", "1000") for i in range(12)]
    rows += [(1, 50, 0, 50, 1, None, "20", "1000"), (1, 51, 0, 51, 1, "bad", "20", "1000")]
    rows += [(1, 52, 9, 52, 1, "3", "2", "1000"), (1, 53, 8, 53, 77, "3", "20", "1000")]
    rows += [(2, 100 + i, 1, i, 1, "4", "20", "500") for i in range(6)]
    params = CompareParams(
        game_ids=(1, 2), missing_items=5, min_performance=1, min_level_rows=2, min_sessions=4
    )
    done = cl.clean(selected(spark, rows), params)
    audit = {
        (r["cohort"], r["step"]): (r["rows_before"], r["rows_after"]) for r in done.audit.collect()
    }
    assert audit[(1, "null_rows")] == (16, 15)
    assert audit[(1, "missing_items")] == (15, 14)
    assert audit[(1, "min_performance")] == (14, 12)
    assert audit[(1, "sparse_levels")] == (12, 11)
    assert audit[(2, "min_sessions")] == (6, 6)
    final = {c: n for (c, step), (_, n) in audit.items() if step == "min_sessions"}
    counted = {r["cohort"]: r["count"] for r in done.sessions.groupBy("cohort").count().collect()}
    assert counted == final
    positions = sorted({r["position"] for r in done.audit.collect()})
    assert positions == list(range(1, len(positions) + 1))
    assert done.sessions.filter("numcorrect IS NULL").count() == 1
    assert done.sessions.filter("playtime = 1").count() == counted[1]


@pytest.mark.parametrize("missing", ["numtries", "numcorrect", "session_level"])
def test_absent_columns(spark, missing):
    rows = [(1, i, 1, i, 1, "3", "4", "1000") for i in range(5)]
    params = replace(PARAMS, outlier_sigma=2, missing_items=2, min_level_rows=2)
    df = selected(spark, rows).drop(missing)
    done = cl.clean(df, params)
    assert missing not in done.sessions.columns
    assert done.sessions.count() == 5


def test_every_step_only_removes_rows(spark, skewed_plays):
    from cohortlens.operators.selection import select_cohorts

    params = CompareParams(
        game_ids=(1, 2),
        min_plays=2,
        missing_items=20,
        min_performance=1,
        outlier_sigma=1.5,
        min_sessions=8,
    )
    audit = cl.clean(select_cohorts(skewed_plays, params), params).audit.collect()
    assert audit
    for row in audit:
        assert 0 <= row["rows_after"] <= row["rows_before"]
