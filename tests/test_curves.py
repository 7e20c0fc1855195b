import math
from dataclasses import replace

import pytest

from cohortlens.model import CompareParams
from cohortlens.operators import curves as cv
from cohortlens.plans import metrics as mt
from tests.conftest import rows_of

PARAMS = CompareParams(game_ids=(1, 2))


def sessions(spark, rows):
    ddl = "cohort int, session_count long, session_level int, user_level int, score double"
    return spark.createDataFrame(rows, ddl)


def staircase(spark):
    """Session k has 10 - k plays."""
    rows = [(c, k, k + i % 3, k + 1, float(k * i)) for c in (1, 2) for k in range(1, 10) for i in range(10 - k)]
    return sessions(spark, rows)


def test_one_row_group(spark):
    df = sessions(spark, [(1, 1, 4, 4, 1.0), (1, 2, 5, 5, 1.0), (1, 2, 7, 5, 1.0)])
    points = {r["key"]: r for r in cv.curves(df, "session_count", ["session_level"]).collect()}
    assert points[1]["stderr"] is None and points[1]["err"] == 0 and points[1]["lo"] is None
    assert points[2]["stderr"] == pytest.approx(math.sqrt(2) / math.sqrt(2))
    assert points[2]["hi"] - points[2]["mean"] == pytest.approx(points[2]["stderr"])


def test_flat_curve_explains_nothing(spark):
    df = sessions(spark, [(1, k, 4, 4, 1.0) for k in (1, 2, 3)])
    fitted = cv.with_fit(cv.curves(df, "session_count", ["session_level"]))
    assert [r["variance_explained"] for r in fitted.collect()] == [None] * 3


def test_points_count_equally(spark):
    df = sessions(
        spark, [(1, 1, 1, 1, 0.0)] * 50 + [(1, 2, 9, 1, 0.0)] + [(1, 3, 2, 1, 0.0)]
    )
    fitted = cv.with_fit(cv.curves(df, "session_count", ["session_level"])).first()
    keys, means = [1, 2, 3], [1, 9, 2]
    cov = sum((k - 2) * (m - 4) for k, m in zip(keys, means))
    r2 = cov**2 / (2 * sum((m - 4) ** 2 for m in means))
    assert fitted["variance_explained"] == pytest.approx(100 * r2)


def test_measure_without_values_is_left_out(spark):
    df = sessions(spark, [(1, 1, 4, 4, None), (1, 2, 4, 4, 2.0)])
    assert [r["key"] for r in cv.curves(df, "session_count", ["score"]).collect()] == [2]


@pytest.mark.parametrize(
    "trim, kept", [(0.0, 8), (0.05, 7), (0.5, 2), (1.0, 0), (1.5, 1), (4.0, 4), (99.0, 9)]
)
def test_trims(spark, trim, kept):
    points = cv.curves(staircase(spark), "session_count", ["score"])
    early = cv.early_curves(points, [trim])
    counts = {r["cohort"]: r["count"] for r in early.groupBy("cohort").count().collect()}
    assert counts == ({1: kept, 2: kept} if kept else {})


def test_sliced_trims_are_the_same(spark):
    points = cv.curves(staircase(spark), "session_count", ["score", "session_level"])
    trims = [0.05, 0.4, 3]
    assert rows_of(cv.early_curves(points, trims)) == rows_of(
        cv.early_curves(points, trims, window_rows=0)
    )


def test_first_points(spark):
    points = cv.curves(staircase(spark), "session_count", ["score"])
    found = cv.first_points(points, 3)
    assert sorted((r["cohort"], r["key"]) for r in found.collect()) == [
        (c, k) for c in (1, 2) for k in (1, 2, 3)
    ]


def test_curves_need_their_columns(spark):
    df = staircase(spark).drop("score")
    names = mt.chosen(df, PARAMS, mt.CURVES)
    assert "level_by_session" in names and "jump_by_level" in names
    assert not any("score" in n or "correct" in n for n in names)
    assert mt.curve_tables(df, PARAMS, ["score_by_level"]) is None


def test_metric_choice(spark):
    df = staircase(spark)
    assert "level_by_session" not in mt.chosen(df, replace(PARAMS, fit_metrics=False), mt.CURVES)
    assert mt.chosen(df, replace(PARAMS, metrics=("score_by_level",)), mt.CURVES) == [
        "score_by_level"
    ]


def test_no_trims(spark):
    df = staircase(spark)
    params = replace(PARAMS, early_learning=())
    assert mt.curve_tables(df, params, ["score_by_session_early"]) is None


def test_linear_fit(spark):
    df = sessions(spark, [(1, k, v, 1, 0.0) for k, v in [(1, 2), (2, 3), (3, 5), (4, 4)]])
    points = cv.curves(df, "session_count", ["session_level"])
    fit = cv.linear_fit(points, 0.95).first()
    assert fit["slope"] == pytest.approx(0.8) and fit["intercept"] == pytest.approx(1.5)
    residuals = [y - (1.5 + 0.8 * x) for x, y in [(1, 2), (2, 3), (3, 5), (4, 4)]]
    squares = sum(r * r for r in residuals)
    assert fit["residual_sd"] == pytest.approx(math.sqrt(squares / 2))
    assert fit["chi_square"] == pytest.approx(squares / 1.25**2)
    assert fit["reduced_chi_square"] == pytest.approx(squares / 1.25**2 / 2)
    t = fit["t_value"]
    assert t == pytest.approx(4.302652729749462, rel=1e-12)
    bands = cv.fit_bands(points, 0.95, points=4).orderBy("point").collect()
    assert [b["x"] for b in bands] == [1, 2, 3, 4]
    for b in bands:
        spread = 0.25 + (b["x"] - 2.5) ** 2 / 5
        half = t * fit["residual_sd"] * math.sqrt(spread)
        assert b["confidence_hi"] - b["fitted"] == pytest.approx(half)
        wide = t * fit["residual_sd"] * math.sqrt(1 + spread)
        assert b["fitted"] - b["prediction_lo"] == pytest.approx(wide)


def test_fit_of_two_points_has_no_spread(spark):
    df = sessions(spark, [(1, 1, 2, 1, 0.0), (1, 2, 3, 1, 0.0)])
    fit = cv.linear_fit(cv.curves(df, "session_count", ["session_level"])).first()
    assert fit["residual_sd"] is None and fit["t_value"] is None and fit["slope"] == pytest.approx(1)


def test_each_curve_has_the_quantile_of_its_own_length(spark):
    rows = [(1, k, k % 3, 1, 0.0) for k in range(1, 6)] + [(2, k, k % 4, 2, 0.0) for k in range(1, 13)]
    points = cv.curves(sessions(spark, rows), "session_count", ["session_level"])
    found = {r["points"]: r["t_value"] for r in cv.linear_fit(points, 0.99).collect()}
    assert found == {
        5: pytest.approx(5.840909309733355, rel=1e-12), 12: pytest.approx(3.169272672616951, rel=1e-12)
    }
