import datetime
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import json_fields
from cohortlens.model import CompareParams
from cohortlens.operators import selection as sl
from tests.conftest import rows_of

PARAMS = CompareParams(game_ids=(1, 2), min_plays=1)
DDL = "game_result_id long, user_id long, game_id int, created_at string"


def plays(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    return df.selectExpr("game_result_id", "user_id", "game_id", "timestamp(created_at) created_at")


def test_unknown_user_in_the_exclusion_list(spark):
    """A NULL among the excluded users must not empty the cohort, as NOT IN would."""
    df = plays(
        spark,
        [
            (1, 10, 1, "2024-01-01"),
            (2, 11, 1, "2024-01-01"),
            (3, 11, 2, "2024-01-01"),
            (4, None, 2, "2024-01-01"),
        ],
    )
    params = replace(PARAMS, exclude_other_game=(True, False))
    found = sl.select_cohorts(df, params)
    assert sorted((r["cohort"], r["user_id"]) for r in found.collect()) == [(1, 10), (2, 11)]


def test_one_row_in_both_cohorts(spark):
    df = plays(spark, [(1, 10, 1, "2024-03-01"), (2, 10, 1, "2024-04-01")])
    params = replace(PARAMS, game_ids=(1, 1), months=(3, 3))
    found = sl.select_cohorts(df, params)
    assert sorted((r["cohort"], r["game_result_id"]) for r in found.collect()) == [(1, 1), (2, 1)]


def test_month_belongs_to_its_cohort_with_and_without_year(spark):
    df = plays(
        spark,
        [(1, 10, 1, "2023-03-01"), (2, 10, 1, "2024-03-01"), (3, 10, 1, "2024-04-01")],
    )
    params = replace(PARAMS, game_ids=(1, 1), months=(3, 4))
    found = sl.select_cohorts(df, params).collect()
    assert sorted((r["cohort"], r["game_result_id"]) for r in found) == [(1, 1), (1, 2), (2, 3)]
    found = sl.select_cohorts(df, replace(params, years=(2024,))).collect()
    assert sorted((r["cohort"], r["game_result_id"]) for r in found) == [(1, 2), (2, 3)]


def test_users_without_id_are_never_active(spark):
    df = plays(spark, [(i, None, 1, "2024-01-01") for i in range(5)])
    for least in (1, 3):
        assert sl.select_cohorts(df, replace(PARAMS, min_plays=least)).count() == 0


def test_active_users_are_counted_before_age_and_version(spark):
    df = plays(spark, [(1, 10, 1, "2024-01-30"), (2, 10, 1, "2023-01-30")])
    params = replace(
        PARAMS, min_plays=2, age_unit="day", age_upper=(5, 5), as_of=datetime.date(2024, 1, 31)
    )
    assert [r["game_result_id"] for r in sl.select_cohorts(df, params).collect()] == [1]


def test_age_window_defaults_to_today(spark):
    df = spark.sql(
        "SELECT 1L game_result_id, 10L user_id, 1 game_id, timestamp(current_date()) created_at"
        " UNION ALL SELECT 2L, 10L, 1, timestamp(date_sub(current_date(), 9))"
    )
    params = replace(PARAMS, age_unit="day", age_upper=(3, 3))
    assert [r["game_result_id"] for r in sl.select_cohorts(df, params).collect()] == [1]


def test_numbers_need_the_results_log(spark):
    df = plays(spark, [(1, 10, 1, "2024-01-01")])
    with pytest.raises(ValueError):
        sl.select_cohorts(df, replace(PARAMS, numbering=("true", "true")))


def test_numbers_run_over_all_results(spark):
    """A play keeps its number when a filter removes earlier ones."""
    df = plays(spark, [(i, 10, 1, f"2024-01-{i:02d}") for i in range(1, 6)])
    log = df.selectExpr("game_result_id AS id", "game_id", "user_id")
    params = replace(
        PARAMS,
        numbering=("true", "true"),
        age_unit="day",
        age_upper=(1, 1),
        as_of=datetime.date(2024, 1, 5),
    )
    found = sl.select_cohorts(df, params, log)
    assert sorted((r["game_result_id"], r["nth"]) for r in found.collect()) == [(4, 4), (5, 5)]


def test_hot_users_give_the_same_cohorts(spark, skewed_plays):
    params = CompareParams(game_ids=(1, 2), min_plays=5, exclude_other_game=(False, True))
    plain = sl.select_cohorts(skewed_plays, params)
    users = sl.count_users(skewed_plays, params, min_rows=100)
    assert {r["user_id"] for r in users.hot.table.collect()} == {1}
    assert rows_of(sl.select_cohorts(skewed_plays, params, users=users)) == rows_of(plain)


def test_labels_are_paths(spark):
    blob = '{"a": {"b": 1, "c": {"d": "x"}}, "n": 2, "N": 3, "it\'s `q`": 4}'
    df = spark.createDataFrame([(1, 10, 1, blob), (2, 10, 2, "no json")], "game_result_id long,"
                               " user_id long, game_id int, metadata string")
    params = replace(
        PARAMS,
        correct_label=("a.b", "a.b"),
        tries_label=("n", "N"),
        playtime_label=("it's `q`", "a.c.d"),
    )
    tagged = sl.tag_cohorts(df, params)
    both = tagged.union(tagged.filter("cohort = 1").withColumn("cohort", F.lit(2)))
    found = sl.extract_fields(both, params).orderBy("game_result_id", "cohort")
    assert [tuple(r) for r in found.select("numcorrect", "numtries", "playtime").collect()] == [
        ("1", "2", "4"),
        ("1", "3", "x"),
        (None, None, None),
    ]


def test_one_parse_unless_names_clash(spark):
    parsed, _ = json_fields("metadata", ["a.b", "a.c", "n"])
    assert len(parsed) == 1
    parsed, read = json_fields("metadata", ["a", "a.b", "n", "N"])
    assert len(parsed) == 2 and len(read) == 4


def test_nan_scores_are_missing(spark):
    df = plays(spark, [(1, 10, 1, "2024-01-01")]).withColumn("score", F.lit(float("nan")))
    assert sl.select_cohorts(df, PARAMS).first()["score"] is None


def test_mixed_numbers_keep_observed_rows_once(spark):
    """A log that was loaded twice does not multiply the plays of the cohort without numbers."""
    df = plays(spark, [(i, 10, 1 + i % 2, "2024-01-01") for i in range(6)])
    log = df.selectExpr("game_result_id AS id", "game_id", "user_id")
    params = replace(PARAMS, numbering=("observed", "true"))
    found = sl.select_cohorts(df, params, log.union(log)).collect()
    assert sorted(r["game_result_id"] for r in found if r["cohort"] == 1) == [0, 2, 4]
    assert {(r["game_result_id"], r["nth"]) for r in found if r["cohort"] == 2} == {
        (1, 1), (3, 3), (5, 5)
    }


def test_parameters_are_normalised():
    today = datetime.date(2024, 5, 1)
    made = CompareParams.create([3, 4], year=[0, 2020], today=today, true_session=True)
    assert made.years == (2024, 2020) and made.numbering == ("true", "true")
    assert CompareParams.create([3, 4], year=["all", "all"]).years is None
    assert CompareParams.create([3, 4], year=None, months=[]).months is None
    assert CompareParams.create([3, 4], year="all").years is None
    assert CompareParams.create([3, 4], year=0, today=today).years == (2024,)
    assert CompareParams.create([3, 4], year="2021").years == (2021,)
    cross = CompareParams.create([3, 4], session_exclusion=[True, False])
    assert cross.numbering == ("cross_game", "observed")
    assert CompareParams.create([3, 4], versions=[0, 2]).versions == (None, 2)
    given = [0.05, 20]
    CompareParams.create([3, 4], early_learning=given, year=given and [0, 0])
    assert given == [0.05, 20]
    with pytest.raises(TypeError):
        CompareParams.create([3, 4], unheard_of=1)
    with pytest.raises(ValueError):
        CompareParams(game_ids=(1, 2), numbering=("guess", "true"))
