"""Skew paths give the same results as plain ones, and plans have the shape that scales."""

import datetime
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortlens.model import CompareParams
from cohortlens.operators import cleaning as cl
from cohortlens.operators import curves as cv
from cohortlens.operators import hotkeys, numbering, prefix
from cohortlens.operators import matrix as mx
from cohortlens.operators import selection as sl
from cohortlens.operators.hotkeys import hot_keys
from cohortlens.plans import metrics as mt
from cohortlens.plans.report import compare
from tests.conftest import rows_of

PARAMS = CompareParams(
    game_ids=(1, 2),
    min_plays=5,
    min_sessions=5,
    outlier_sigma=2,
    plot_sigma=8,
    sample_users=20,
    numbering=("cross_game", "true"),
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def at_any_size(spark, make):
    """What comes out when no table is known to be small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def results(plays):
    return plays.selectExpr("game_result_id AS id", "game_id", "user_id")


def compared(spark, plays, params):
    done = compare(spark, plays, params, results(plays))
    tables = {n: rows_of(t) for n, t in done.tables.items() if n != "run"}
    done.release()
    return tables


def test_hot_users_change_no_result(spark, skewed_plays, monkeypatch):
    expected = compared(spark, skewed_plays, PARAMS)
    monkeypatch.setattr(hotkeys, "HOT_ROWS", 30)
    monkeypatch.setattr(prefix, "WINDOW_ROWS", 3)
    monkeypatch.setattr(prefix, "SLICE_ROWS", 40)
    found = compared(spark, skewed_plays, PARAMS)
    assert set(found) == set(expected)
    for name, rows in expected.items():
        assert found[name] == rows, name


def test_results_do_not_depend_on_partitioning(spark, skewed_plays):
    params = replace(PARAMS, numbering=("observed", "observed"))
    assert compared(spark, skewed_plays.repartition(13), params) == compared(
        spark, skewed_plays.coalesce(1), params
    )


def test_all_hot_keys_are_listed(spark, skewed_plays, monkeypatch):
    assert not hot_keys(skewed_plays, ["user_id"], 1000)
    listed = hot_keys(skewed_plays, ["user_id"], 100)
    assert [r["user_id"] for r in listed.table.collect()] == [1] and listed.total_rows == 400
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", 5)
    many = hot_keys(skewed_plays, ["user_id"], 2)
    assert not many.few and many.table.count() == 41 and many.total_rows == 1200


def test_many_hot_keys_change_no_result(spark, skewed_plays, monkeypatch):
    params = replace(PARAMS, metrics=("plays_per_user", "score_by_session"))
    expected = compared(spark, skewed_plays, params)
    monkeypatch.setattr(hotkeys, "HOT_ROWS", 5)
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", 2)
    assert compared(spark, skewed_plays, params) == expected


def test_anonymous_results_are_a_hot_key(spark, skewed_plays, monkeypatch):
    """A third of the log has no user: these results are cut into slices like any hot key's."""
    log = results(skewed_plays).withColumn("user_id", F.expr("nullif(user_id, 1)"))
    log = log.union(log.filter("id < 50"))
    expected = rows_of(numbering.rank_results(log, ["game_id", "user_id"]))
    monkeypatch.setattr(prefix, "SLICE_ROWS", 40)
    sliced = numbering.rank_results(log, ["game_id", "user_id"], min_rows=100)
    assert prefix.SLICE in plan(sliced) and rows_of(sliced) == expected


def test_log_is_counted_once_for_both_modes(spark, skewed_plays, monkeypatch):
    """Hot keys of either mode come from one table of counts, with the ranks of a count per mode."""
    log = results(skewed_plays).withColumn("user_id", F.expr("nullif(user_id, 1)"))
    plays = skewed_plays.withColumn("user_id", F.expr("IF(user_id = 1, 2L, user_id)"))
    both = replace(PARAMS, numbering=("cross_game", "true"))
    expected = rows_of(sl.select_cohorts(plays, both, log))
    counted = []
    original = sl.count_results
    monkeypatch.setattr(sl, "count_results", lambda *a: counted.append(original(*a)) or counted[-1])
    monkeypatch.setattr(numbering, "hot_keys", None)
    monkeypatch.setattr(hotkeys, "HOT_ROWS", 150)
    assert rows_of(sl.select_cohorts(plays, both, log)) == expected and len(counted) == 1
    known = counted[0].filter("user_id IS NULL").groupBy().sum(hotkeys.ROWS).first()[0]
    assert known == 400


def test_log_is_read_once_for_all_modes(spark, skewed_plays, tmp_path):
    for name, frame in (("plays", skewed_plays), ("log", results(skewed_plays))):
        frame.write.parquet(str(tmp_path / name))
    plays, log = (spark.read.parquet(str(tmp_path / n)) for n in ("plays", "log"))
    for modes in (("cross_game", "true"), ("true", "observed"), ("true", "true")):
        text = plan(sl.select_cohorts(plays, replace(PARAMS, numbering=modes), log))
        # Plays, the counts of their users that were set aside, and the log.
        assert text.count("FileScan") == 3 and text.count("from_json") <= 2


def test_hot_key_is_spread_over_slices(spark, skewed_plays, monkeypatch):
    """No slice of the numbering holds more than a share of the hot user's rows."""
    monkeypatch.setattr(prefix, "SLICE_ROWS", 40)
    crowded = skewed_plays.filter("user_id = 1")
    sliced = []
    original = prefix.materialise
    monkeypatch.setattr(
        prefix, "materialise", lambda df: sliced.append(original(df)) or sliced[-1]
    )
    order = ["event_created_at", "game_result_id"]
    numbered = prefix.sliced_totals(crowded, ["user_id"], order, {"n": F.lit(1)}, 400)
    assert sorted(r["n"] for r in numbered.collect()) == list(range(1, 401))
    sizes = [r["count"] for r in sliced[0].groupBy(prefix.SLICE).count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 120


def test_hot_rows_are_salted_before_the_shuffle(spark, skewed_plays):
    tagged = sl.tag_cohorts(skewed_plays, PARAMS)
    hot = hot_keys(tagged, sl.USER, 100)
    counted = numbering.count_rows(tagged, sl.USER, "n", hot)
    assert re.search(r"Exchange hashpartitioning\(cohort#\d+, user_id#\d+L, _salt#", plan(counted))
    assert {r["n"] for r in counted.filter("user_id = 1").collect()} == {200}


@pytest.fixture(scope="module")
def partitioned(spark, skewed_plays, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plays") / "plays")
    dated = skewed_plays.selectExpr("*", "2024 AS yyyy", "1 + CAST(game_result_id % 3 AS INT) AS mm")
    dated.write.partitionBy("yyyy", "mm").parquet(path)
    return spark.read.parquet(path)


def test_selection_prunes_and_shuffles_once(partitioned):
    params = CompareParams(game_ids=(1, 2), min_plays=5, years=(2024,), months=(1, 2))
    counting = plan(sl.count_users(partitioned, params).counts)
    spark = partitioned.sparkSession
    text = at_any_size(spark, lambda: plan(sl.select_cohorts(partitioned, params)))
    scans = [*counting.split("FileScan")[1:], text.split("FileScan")[1]]
    assert len(scans) == 2 and text.count("FileScan") == 2
    for scan in scans:
        assert re.search(r"PartitionFilters: \[.*mm#\d+ IN \(1,2\)", scan)
        assert re.search(r"PushedFilters: \[[^\]]*In\(game_id, \[1,2\]\)", scan)
    # Plays move once; the counts of users, which were set aside, move besides.
    assert text.count("Exchange ") == 2 and "SinglePartition" not in text
    # No build side of unknown size is forced into memory.
    assert "ShuffledHashJoin" not in text and "SortMergeJoin" in text
    # The blob is parsed below the shuffle, so only the values travel.
    assert text.index("Exchange") < text.index("from_json") < text.index("FileScan")
    # Counting reads the keys only.
    assert "struct<user_id:bigint,game_id:bigint>" in scans[0]


def test_both_user_filters_share_a_shuffle(partitioned):
    params = CompareParams(game_ids=(1, 2), min_plays=5, exclude_other_game=(True, True))
    spark = partitioned.sparkSession
    text = at_any_size(spark, lambda: plan(sl.select_cohorts(partitioned, params)))
    # One for the plays; one for the counts, one for the users of the other game.
    assert text.count("Exchange ") == 3 and text.count("SortMergeJoin") == 2


def test_one_scan_serves_overlapping_cohorts(partitioned):
    params = CompareParams(game_ids=(1, 1), min_plays=1, months=(1, 2))
    assert plan(sl.select_cohorts(partitioned, params)).count("FileScan") == 1


def test_time_filters_reach_the_scan(spark, skewed_plays, tmp_path):
    path = str(tmp_path / "plays")
    skewed_plays.write.parquet(path)
    plays = spark.read.parquet(path)
    params = CompareParams(
        game_ids=(1, 2),
        min_plays=1,
        years=(2023, 2024),
        age_unit="day",
        age_upper=(4, 4),
        as_of=datetime.date(2024, 1, 3),
    )
    text = plan(sl.select_cohorts(plays, params))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThanOrEqual(created_at" in pushed and "LessThan" in pushed
    assert "created_at,2023-12-28" in pushed


def test_numbering_and_counting_share_a_shuffle(spark, skewed_plays):
    selected = sl.select_cohorts(skewed_plays, CompareParams(game_ids=(1, 2), min_plays=1))
    text = plan(cl.number_sessions(selected, "plays"))
    assert text.count("Exchange ") == 1 and text.count("Sort ") == 1


def test_first_sessions_are_limited_before_the_shuffle(spark, skewed_plays):
    selected = sl.select_cohorts(skewed_plays, CompareParams(game_ids=(1, 2), min_plays=1))
    places = plan(mx.first_sessions(cl.number_sessions(selected), 3))
    assert "WindowGroupLimit" in places
    points = cv.curves(selected.withColumn("session_count", F.col("user_id")), "session_count", ["score"])
    assert "WindowGroupLimit" in plan(cv.first_points(points, 3))


def test_no_python_and_no_gathering(spark, skewed_plays):
    params = replace(PARAMS, numbering=("observed", "observed"))
    done = compare(spark, skewed_plays, params)
    for name, table in done.tables.items():
        text = plan(table)
        for word in ("Python", "Pandas", "SinglePartition", "CartesianProduct", "NestedLoop"):
            assert word not in text, f"{word} in {name}"
        # Only exact p-values of small samples, a row per test, are worked out in Python.
        assert name == "distribution_tests" or "MapInArrow" not in text
    done.release()


def test_curves_read_only_their_columns(spark, skewed_plays, tmp_path):
    path = str(tmp_path / "sessions")
    selected = sl.select_cohorts(skewed_plays, CompareParams(game_ids=(1, 2), min_plays=1))
    cl.number_sessions(selected).write.parquet(path)
    text = plan(mt.curve_tables(spark.read.parquet(path), PARAMS, ["score_by_level"]))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"cohort", "session_level", "score"}


def test_age_windows_read_only_their_months(spark, skewed_plays, tmp_path):
    """Limits on the folders come from the interval of ages; the rows are those of a plain table."""
    days = "timestamp'2023-11-20' + make_interval(0, 0, 0, CAST(game_result_id % 130 AS INT))"
    plain = skewed_plays.withColumn("created_at", F.expr(days))
    path = str(tmp_path / "plays")
    plain.selectExpr("*", "year(created_at) AS yyyy", "month(created_at) AS mm").write.partitionBy("yyyy", "mm").parquet(path)
    plays = spark.read.parquet(path)
    for unit, upper in (("day", (9, 40)), ("week", (1, 3)), ("month", (1, 2))):
        params = CompareParams(
            game_ids=(1, 2), min_plays=1, age_unit=unit, age_lower=(1, 0), age_upper=upper,
            as_of=datetime.date(2024, 3, 20),
        )
        pruned = sl.select_cohorts(plays, params)
        scan = next(s for s in plan(pruned).split("FileScan") if "PartitionFilters" in s and "created_at" in s)
        found = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan).group(1)
        assert re.search(r"yyyy#\d+ >= \d+.*yyyy#\d+ \* 12\) \+ mm#\d+\) >= \d+", found)
        assert pruned.count() and rows_of(pruned) == rows_of(sl.select_cohorts(plain, params))
    # A window of a few days leaves one folder out of five.
    near = sl.age_partitions(plays, replace(params, age_unit="day", age_upper=(9, 9)))
    assert {tuple(r) for r in near.select("yyyy", "mm").distinct().collect()} == {(2024, 3)}
