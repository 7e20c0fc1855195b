import pytest
from pyspark.sql import functions as F

from cohortlens.operators import matrix as mx
from tests.conftest import rows_of


def sessions(spark, levels):
    """{(cohort, user): [level, ...]} to one row per play."""
    rows = [(c, u, k, v) for (c, u), vs in levels.items() for k, v in enumerate(vs, start=1)]
    return spark.createDataFrame(
        rows, "cohort int, user_id long, session_count long, session_level int"
    )


def users(spark, n):
    return spark.range(n).selectExpr(
        "1 AS cohort", "id AS user_id", "CAST(id % 5 AS INT) AS s1", "CAST(id % 3 AS INT) AS s2"
    )


def test_users_who_miss_a_session_are_left_out(spark):
    df = sessions(spark, {(1, 7): [1, 2, 3, 9], (1, 8): [4, 5], (2, 9): [6, 7, 8]})
    found = {r["user_id"]: (r["s1"], r["s2"], r["s3"]) for r in mx.level_matrix(df, 3).collect()}
    assert found == {7: (1, 2, 3), 9: (6, 7, 8)}


def test_cohort_with_fewer_sessions(spark):
    df = sessions(spark, {(1, 7): [1, 2, 3], (2, 9): [6, 7]})
    found = {r["user_id"]: (r["s1"], r["s2"], r["s3"]) for r in mx.level_matrix(df, 3).collect()}
    assert found == {7: (1, 2, 3), 9: (6, 7, None)}


def test_columns_are_the_lowest_numbers_of_the_cohort(spark):
    df = sessions(spark, {(1, 7): [1, 2, 3], (1, 8): [4, 5, 6]})
    later = df.withColumn("session_count", F.col("session_count") * 10)
    found = {r["user_id"]: (r["s1"], r["s2"]) for r in mx.level_matrix(later, 2).collect()}
    assert found == {7: (1, 2), 8: (4, 5)}


def test_highest_level_of_a_repeated_number(spark):
    df = sessions(spark, {(1, 7): [1, 2]}).union(sessions(spark, {(1, 7): [5, 1]}))
    assert mx.level_matrix(df, 2).select("s1", "s2").collect() == [(5, 2)]


def rule(n, most):
    """Ordinals the sample takes, from the rule in words."""
    if n <= most:
        return list(range(n)), "all"
    step = round(n / most)
    if step == 1:
        return list(range(n - most + 1, n)), "top"
    return list(range(step, n, step))[: most - 1], "downsampled"


@pytest.mark.parametrize(
    "n, most", [(9, 10), (10, 10), (11, 10), (15, 10), (25, 10), (26, 10), (35, 10), (101, 4)]
)
def test_sample(spark, n, most):
    found = mx.sample_users(users(spark, n), most).collect()
    ordinals, kind = rule(n, most)
    assert sorted(r["ordinal"] for r in found) == ordinals
    assert {r["sample"] for r in found} == {kind}


def test_order_and_slices(spark):
    matrix = users(spark, 60).union(users(spark, 33).withColumn("cohort", F.lit(2)))
    plain, sliced = mx.ordered_users(matrix), mx.ordered_users(matrix, window_rows=0)
    assert rows_of(plain) == rows_of(sliced)
    first = sorted(
        (r for r in plain.collect() if r["cohort"] == 1), key=lambda r: r["ordinal"]
    )
    keys = [(r["s1"], r["s2"], r["user_id"]) for r in first]
    assert keys == sorted(keys) and [r["ordinal"] for r in first] == list(range(60))


def test_level_stops(spark):
    df = spark.createDataFrame(
        [(1, 1, 2, 5), (1, 2, 1, 12), (2, 3, 4, 4)], "cohort int, user_id long, s1 int, s2 int"
    )
    stops = mx.level_stops(df)
    assert [r["level"] for r in stops.filter("cohort = 1").orderBy("stop").collect()] == list(
        range(1, 13)
    )
    assert {r["level"] for r in stops.filter("cohort = 2").collect()} == {4.0}


def test_jump_by_session(spark):
    rows = [(1, 7, k, 10 * k, 1, 1 + k) for k in (1, 2, 3)] + [(1, 8, 1, 5, 3, 1)]
    df = spark.createDataFrame(
        rows,
        "cohort int, user_id long, session_count long, event_created_at int,"
        " session_level int, user_level int",
    )
    found = {r["key"]: r for r in mx.jump_by_session(df, 2).collect()}
    assert sorted(found) == [0, 1]
    assert (found[0]["n"], found[0]["mean"]) == (2, -0.5)
    assert {(r["lowest_jump"], r["highest_jump"]) for r in found.values()} == {(-2, 2)}
    renumbered = df.withColumn("session_count", F.col("session_count") + 100)
    assert rows_of(mx.jump_by_session(renumbered, 2, play_order=True)) == rows_of(
        mx.jump_by_session(df, 2)
    )
