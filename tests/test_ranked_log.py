"""The kept results log: appends give the numbers of a full ranking, and sort only what is new."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.model import CompareParams
from cohortlens.operators import ranked_log as rl
from cohortlens.operators import selection as sl
from cohortlens.operators.numbering import rank_results
from cohortlens.session import Workspace, early_filter
from tests.conftest import rows_of

DDL = "id long, game_id int, user_id long"


def results(spark, rows):
    return spark.createDataFrame(rows, DDL)


def full(log):
    ranked = log.filter("game_id IN (1, 2)")
    for mode, keys in rl.MODES.items():
        ranked = rank_results(ranked, keys, f"nth_{mode}")
    return ranked


@pytest.fixture
def workspace(spark):
    with Workspace(spark) as own, own.current():
        yield own


def drawn(seed, n=400):
    rng = random.Random(seed)
    users = [None, 1, 1, 1, *range(2, 20)]
    rows = [(i, rng.choice([1, 2, 3]), rng.choice(users)) for i in range(n)]
    return rows + [rng.choice(rows) for _ in range(20)]  # some results are there twice


def test_appends_in_order(spark, workspace, tmp_path):
    rows = sorted(drawn(1), key=lambda r: r[0])
    for low, high in ((0, 150), (150, 160), (160, 160), (160, 500)):
        batch = [r for r in rows if low <= r[0] < high]
        rl.append_results(str(tmp_path), results(spark, batch), (2, 1))
    found = rl.read_ranked(spark, str(tmp_path))
    assert rows_of(found) == rows_of(full(results(spark, rows)).select(*found.columns))
    assert len(list((tmp_path / "parts").iterdir())) == 3  # the empty batch made none


def test_late_results_rank_all_again(spark, workspace, tmp_path):
    rows = drawn(2)
    for part in range(3):
        rl.append_results(str(tmp_path), results(spark, [r for r in rows if r[0] % 3 == part]), (1, 2))
    found = rl.read_ranked(spark, str(tmp_path))
    assert rows_of(found) == rows_of(full(results(spark, rows)).select(*found.columns))


def test_an_append_sorts_only_new_results(spark, workspace, tmp_path, monkeypatch):
    rl.append_results(str(tmp_path), spark.range(5000).selectExpr("id", "1 AS game_id", "id % 50 AS user_id"), (1, 2))
    ranked = []
    monkeypatch.setattr(rl, "rank_results", lambda df, *a: ranked.append(df.count()) or rank_results(df, *a))
    rl.append_results(str(tmp_path), results(spark, [(9000 + i, 1, i % 60) for i in range(70)]), (1, 2))
    assert ranked == [70, 70]
    numbers = {r.id: r.nth_true for r in rl.read_ranked(spark, str(tmp_path)).filter("id >= 9000").collect()}
    assert numbers[9000] == 101 and numbers[9059] == 1 and numbers[9060] == 102


def test_a_log_is_kept_for_its_games(spark, workspace, tmp_path):
    with pytest.raises(ValueError):
        rl.read_ranked(spark, str(tmp_path))
    rl.append_results(str(tmp_path), results(spark, [(1, 1, 1), (2, 3, 1)]), (1, 2))
    assert rl.read_ranked(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError):
        rl.append_results(str(tmp_path), results(spark, [(3, 1, 1)]), (1, 3))


def test_a_killed_append_changes_nothing(spark, workspace, tmp_path, monkeypatch):
    rl.append_results(str(tmp_path), results(spark, [(1, 1, 1)]), (1, 2))
    with monkeypatch.context() as patched:
        patched.setattr(rl.time, "time_ns", lambda: 1 / 0)  # after both tables, before the manifest
        with pytest.raises(ZeroDivisionError):
            rl.append_results(str(tmp_path), results(spark, [(2, 1, 1)]), (1, 2))
    assert rl.read_ranked(spark, str(tmp_path)).count() == 1
    rl.append_results(str(tmp_path), results(spark, [(2, 1, 1)]), (1, 2))
    assert [r.nth_true for r in rl.read_ranked(spark, str(tmp_path)).orderBy("id").collect()] == [1, 2]


@pytest.mark.parametrize("numbering", [("true", "true"), ("cross_game", "true"), ("observed", "cross_game")])
def test_cohorts_by_a_kept_log(spark, workspace, skewed_plays, tmp_path, numbering):
    log = skewed_plays.selectExpr("game_result_id AS id", "game_id", "user_id")
    for condition in ("id < 700", "id >= 700"):
        rl.append_results(str(tmp_path), log.filter(condition), (1, 2))
    params = CompareParams(game_ids=(1, 2), min_plays=2, numbering=numbering)
    kept = sl.select_cohorts(skewed_plays, params, rl.read_ranked(spark, str(tmp_path)))
    assert rows_of(kept) == rows_of(sl.select_cohorts(skewed_plays, params, log))
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text  # the log is joined as it is


def test_early_filter_drops_rows_before_the_shuffle(spark, workspace, tmp_path):
    """Spark's Bloom filter of the active users stands below the shuffle, and the join makes it exact."""
    many = "IF(id % 50 = 0, id % 97, id)"
    spark.range(40_000).selectExpr(
        "id AS game_result_id", f"{many} AS user_id", "1 + CAST(id % 2 AS INT) AS game_id",
        "timestamp'2024-01-01' AS created_at", "timestamp'2024-01-01' AS event_created_at",
    ).write.parquet(f"{tmp_path}/plays")
    plays = spark.read.parquet(f"{tmp_path}/plays")
    params = CompareParams(game_ids=(1, 2), min_plays=5)
    name = "spark.sql.optimizer.runtime.bloomFilter."
    conf = {f"{name}applicationSideScanSizeThreshold": "1b", f"{name}creationSideThreshold": "1b",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        users = sl.count_users(plays, params)
        wanted = users.counts.filter(F.col("_key_rows") >= 5).count()
        plain = sl.select_cohorts(plays, params, users=users)
        expected = rows_of(plain)
        assert "might_contain" not in plain._jdf.queryExecution().optimizedPlan().toString()
        with early_filter(spark, wanted):
            early = sl.select_cohorts(plays, params, users=users)
            assert rows_of(early) == expected
            text = early._jdf.queryExecution().executedPlan().toString()
            below = text[text.index("Exchange hashpartitioning(cohort") :]
            assert "might_contain" in below
        assert spark.conf.get(f"{name}creationSideThreshold") == "1b"
    finally:
        for key in conf:
            spark.conf.unset(key)
    with early_filter(spark, 10**9):
        assert spark.conf.get(f"{name}creationSideThreshold", "10MB") == "10MB"
