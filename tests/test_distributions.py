import bisect
import itertools
import math
import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.model import CompareParams
from cohortlens.operators import distributions as ds
from cohortlens.plans import metrics as mt
from tests.conftest import rows_of

PARAMS = CompareParams(game_ids=(1, 2))


def frequencies(spark, first, second, metric="m"):
    rows = [(metric, c, float(v)) for c, vs in ((1, first), (2, second)) for v in vs]
    df = spark.createDataFrame(rows, "metric string, cohort int, value double")
    return df.groupBy("metric", "cohort", "value").count().withColumnRenamed("count", "n")


def distance(first, second):
    first, second = sorted(first), sorted(second)
    return max(
        abs(bisect.bisect_right(first, v) / len(first) - bisect.bisect_right(second, v) / len(second))
        for v in first + second
    )


def test_of(spark, first, second, window_rows=None):
    counted = frequencies(spark, first, second)
    return ds.ks_tests(counted, ds.Profile.of(counted), window_rows).first()


test_of.__test__ = False


def histogram(spark, first, second):
    counted = frequencies(spark, first, second)
    return ds.histograms(counted, ds.Profile.of(counted)).orderBy("cohort", "bin").collect()


def test_equal_samples_have_no_distance(spark):
    found = test_of(spark, [1, 2, 2, 5], [5, 2, 1, 2])
    assert (found["d"], found["p_value"], found["shape_d"]) == (0, 1, 0)
    assert found["same_distribution"] and found["same_shape"]


def test_scaled_samples_have_the_same_shape(spark):
    first = [random.Random(1).uniform(1, 9) for _ in range(200)]
    found = test_of(spark, first, [4 * v for v in first])
    assert not found["same_distribution"]
    assert found["same_shape"]


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.integers(-20, 20), min_size=1, max_size=60),
    st.lists(st.integers(-20, 20), min_size=1, max_size=60),
)
def test_distance_is_the_textbook_one(spark, first, second):
    found = test_of(spark, first, second)
    assert found["d"] == pytest.approx(distance(first, second), abs=1e-12)
    assert 0 <= found["d"] <= 1 and 0 <= found["p_value"] <= 1
    assert (found["n1"], found["n2"]) == (len(first), len(second))


def test_distance_is_symmetric(spark):
    rng = random.Random(3)
    first = [rng.gauss(0, 1) for _ in range(80)]
    second = [rng.gauss(0.4, 1) for _ in range(120)]
    a, b = test_of(spark, first, second), test_of(spark, second, first)
    assert a["d"] == pytest.approx(b["d"]) and a["p_value"] == pytest.approx(b["p_value"])


def test_sliced_sums_give_the_same_distance(spark):
    rng = random.Random(4)
    first = [rng.gauss(5, 1) for _ in range(300)]
    second = [rng.choice(first) for _ in range(200)]
    assert rows_of(
        ds.ks_tests(*_profiled(spark, first, second))
    ) == rows_of(ds.ks_tests(*_profiled(spark, first, second), window_rows=0))


def _profiled(spark, first, second):
    counted = frequencies(spark, first, second)
    return counted, ds.Profile.of(counted)


def test_one_empty_cohort(spark):
    found = test_of(spark, [1, 2], [])
    assert (found["n1"], found["n2"], found["d"], found["p_value"]) == (2, 0, None, None)


def test_histogram_counts_every_value_once(spark):
    rng = random.Random(5)
    first = [rng.uniform(0, 50) for _ in range(150)]
    second = [rng.uniform(20, 90) for _ in range(90)]
    rows = histogram(spark, first, second)
    assert len(rows) == 60
    for cohort, values in ((1, first), (2, second)):
        mine = [r for r in rows if r["cohort"] == cohort]
        assert sum(r["own_count"] for r in mine) == len(values)
        assert sum(r["shared_count"] for r in mine) == len(values)
        area = sum(r["density"] * (r["shared_hi"] - r["shared_lo"]) for r in mine)
        assert area == pytest.approx(1)
        for r in mine:
            last = r["bin"] == 29
            inside = sum(
                r["own_lo"] <= v < r["own_hi"] or (last and v == r["own_hi"]) for v in values
            )
            assert r["own_count"] == inside


def test_values_on_bin_edges(spark):
    """Whole numbers over a range of 10 bins fall on edges that are not exact in binary."""
    values = [v / 10 for v in range(0, 11)]
    rows = [r for r in histogram(spark, values, values) if r["cohort"] == 1]
    assert [r["own_count"] for r in rows] == [
        sum(
            r["own_lo"] <= v < r["own_hi"] or (r["bin"] == 9 and v == r["own_hi"]) for v in values
        )
        for r in rows
    ]
    assert rows[-1]["own_hi"] == 1.0 and rows[-1]["own_count"] >= 1


def test_range_of_one_point_is_widened(spark):
    rows = [r for r in histogram(spark, [4, 4, 4], [1, 2]) if r["cohort"] == 1]
    assert (rows[0]["own_lo"], rows[-1]["own_hi"]) == (3.5, 4.5)
    assert sum(r["own_count"] for r in rows) == 3


@pytest.mark.parametrize(
    "highest, bins", [(18.9, 10), (19, 20), (28.5, 20), (29, 30), (500, 30), (0, 10)]
)
def test_bin_count(highest, bins):
    assert ds.bin_count(0, highest) == bins


def cleaned(spark, rows):
    ddl = (
        "cohort int, user_id long, session_count long, playtime double, numcorrect double,"
        " numtries double, user_level int, session_level int, score double"
    )
    return spark.createDataFrame(rows, ddl)


def plays_of(spark, scores):
    """One play per user: (cohort, score, correct, tries)."""
    return cleaned(
        spark,
        [(c, i, 1, 1.0, a, b, 2, 1, float(s)) for i, (c, s, a, b) in enumerate(scores)],
    )


def test_cut_without_mean_is_strict(spark):
    scores = [1.0, 2.0, 3.0, 10.0]
    mean = sum(scores) / 4
    sd = math.sqrt(sum((s - mean) ** 2 for s in scores) / 3)
    df = plays_of(spark, [(c, s, 1.0, 1.0) for c in (1, 2) for s in scores])
    params = replace(PARAMS, plot_sigma=0.5)
    found = mt.distribution_tables(df, params, ["score_per_user"]).summary.collect()
    for row in found:
        assert row["cutoff"] == pytest.approx(sd / 2)
        assert row["excluded"] == sum(s >= sd / 2 for s in scores) and row["total"] == 4


def test_time_cut_is_per_cohort(spark):
    df = cleaned(
        spark,
        [(c, i, 1, t, 1.0, 1.0, 1, 1, 1.0) for c in (1, 2) for i, t in enumerate([1.0, 2.0, 9.0])],
    )
    params = replace(PARAMS, time_sigma=(1, 0))
    found = mt.distribution_tables(df, params, ["longest_play"]).summary.collect()
    assert {r["cohort"]: r["excluded"] for r in found} == {1: 1, 2: 0}
    assert {r["cohort"]: r["cutoff"] is None for r in found} == {1: False, 2: True}


def test_user_without_a_value_counts_as_excluded(spark):
    df = plays_of(spark, [(1, 1, None, 1.0), (1, 1, 2.0, 1.0), (1, 1, 3.0, 1.0), (2, 1, 2.0, 1.0)])
    found = mt.distribution_tables(df, replace(PARAMS, plot_sigma=9), ["correct_per_user"])
    first = found.summary.filter("cohort = 1").first()
    assert (first["total"], first["excluded"]) == (3, 1)


def test_percent_rules(spark):
    """Infinity becomes 0, 0/0 is unknown, and halves round to the even number."""
    df = plays_of(
        spark,
        [(1, 1, 3.0, 0.0), (1, 1, 0.0, 0.0), (1, 1, 1.0, 8.0), (1, 1, 3.0, 8.0)],
    )
    users = ds.per_user(df)
    values = [r[0] for r in users.selectExpr(ds.PERCENT_PER_USER).collect()]
    assert sorted(values, key=lambda v: (v is None, v)) == [0.0, 12.0, 38.0, None]
    counts = mt.infinite_percents(df).first()
    assert (counts["users"], counts["plays"]) == (1, 1)


def test_constant_percent_is_not_drawn(spark):
    df = plays_of(spark, [(c, s, 1.0, 2.0) for c in (1, 2) for s in (1, 2, 3)])
    params = replace(PARAMS, plot_sigma=0)
    found = mt.distribution_tables(df, params, ["percent_per_user", "score_per_user"])
    assert {r["metric"] for r in found.histograms.collect()} == {"score_per_user"}
    assert {r["metric"] for r in found.tests.collect()} == {"score_per_user"}
    assert found.summary.count() == 4


def test_shape_of_zeros(spark):
    found = test_of(spark, [0, 0, 0], [0, 0])
    assert found["shape_d"] == 0


def enumerated(first, second):
    """Share of all orders of the pooled places whose distance is that of the samples or more."""
    m, n, d = len(first), len(second), distance(first, second)
    far = total = 0
    for chosen in itertools.combinations(range(m + n), m):
        i = j = 0
        most = 0.0
        for place in range(m + n):
            i, j = (i + 1, j) if place in chosen else (i, j + 1)
            most = max(most, abs(i / m - j / n))
        far, total = far + (most >= d - 1e-12), total + 1
    return far / total


@pytest.mark.parametrize(
    "first, second",
    [
        ([1, 2, 3, 4, 5], [4, 5, 6, 7, 8, 9]),
        ([1], [2]),
        ([1, 2], [1, 2, 3, 4, 5, 6]),
        ([1, 1, 2, 2, 9, 9, 9], [2, 2, 3, 3, 4]),
        ([1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12]),
    ],
)
def test_exact_p_of_small_samples(spark, first, second):
    found = test_of(spark, first, second)
    assert found["method"] == "exact"
    assert found["p_value"] == pytest.approx(enumerated(first, second), rel=1e-12)


def test_exact_p_of_known_cases(spark):
    """Samples that do not overlap: 2 / C(2 n, n), however small that is."""
    n = 60
    found = test_of(spark, range(1, n + 1), range(n + 1, 2 * n + 1))
    assert found["p_value"] == pytest.approx(2 / math.comb(2 * n, n), rel=1e-10)


def test_methods_meet(spark):
    """Where samples grow, both ways come near each other; the larger sample decides."""
    first, second = [k * 1.03 for k in range(400)], list(range(300))
    counted = frequencies(spark, first, second)
    profile = ds.Profile.of(counted)
    exact = ds.ks_tests(counted, profile, exact_rows=400).first()
    series = ds.ks_tests(counted, profile, exact_rows=399).first()
    assert (exact["method"], series["method"]) == ("exact", "asymptotic")
    assert exact["d"] == series["d"] and exact["p_value"] == pytest.approx(series["p_value"], abs=0.01)


def test_no_method_without_a_sample(spark):
    found = test_of(spark, [1, 2], [])
    assert (found["p_value"], found["method"]) == (None, None)
