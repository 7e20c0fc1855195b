"""Means along a key, with errors, fits and trims."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import percent, standard_error, t_quantile, variance_explained
from cohortlens.operators.prefix import running_totals


@dataclass(frozen=True)
class Measure:
    """A row value whose mean is followed along a key.

    ``mean`` replaces the plain average as the plotted mean; the fit still uses the average.
    """

    value: str
    needs: tuple[str, ...]
    mean: str | None = None


MEASURES = {
    "session_level": Measure("session_level", ("session_level",)),
    "numcorrect": Measure("numcorrect", ("numcorrect",)),
    "percent_correct": Measure(percent("numcorrect", "numtries"), ("numcorrect", "numtries")),
    "level_jump": Measure(
        "user_level - session_level",
        ("user_level", "session_level"),
        "avg(user_level) - avg(session_level)",
    ),
    "score": Measure("score", ("score",)),
}


def curves(df: DataFrame, key: str, names: Iterable[str]) -> DataFrame:
    """One row per measure, cohort and key, from a single aggregation by key."""
    aggregates = []
    for name in names:
        value = MEASURES[name].value
        mean = MEASURES[name].mean or f"avg({value})"
        aggregates.append(
            f"struct('{name}' AS measure, count({value}) AS n, CAST({mean} AS DOUBLE) AS mean,"
            f" stddev_samp({value}) AS sd, CAST(avg({value}) AS DOUBLE) AS fit_mean)"
        )
    grouped = df.groupBy("cohort", F.col(key).alias("key")).agg(
        F.expr(f"array({', '.join(aggregates)})").alias("points")
    )
    long = grouped.selectExpr("cohort", "CAST(key AS BIGINT) AS key", "inline(points)")
    return with_bands(long.filter("mean IS NOT NULL"))


def with_bands(curve: DataFrame) -> DataFrame:
    """Standard error (NULL for one row), error bar (0 for one row) and mean +/- error."""
    return curve.selectExpr("*", f"{standard_error('sd', 'n')} AS stderr").selectExpr(
        "*", "coalesce(stderr, 0D) AS err", "mean - stderr AS lo", "mean + stderr AS hi"
    )


def with_fit(curve: DataFrame, groups: Iterable[str] = ("measure", "cohort")) -> DataFrame:
    """Add the variance explained by a straight line through each curve's points.

    The points count equally, however many plays are behind them.
    """
    groups = list(groups)
    fits = curve.groupBy(*groups).agg(
        F.expr(variance_explained("key", "fit_mean")).alias("variance_explained")
    )
    # One row per curve: at most cohorts x measures x trims, all fixed by the parameters.
    return curve.join(F.broadcast(fits), groups)


def early_curves(
    curve: DataFrame, trims: Iterable[float], window_rows: int | None = None
) -> DataFrame:
    """The early part of each curve, once per trim.

    A trim up to 1 is a fraction of plays to leave out at the far end; a larger one is the
    number of leading points to keep.
    """
    groups = ["measure", "cohort"]
    placed = running_totals(
        curve, groups, ["key"], {"_plays": F.col("n"), "_place": F.lit(1)}, window_rows
    )
    totals = curve.groupBy(*groups).agg(F.sum("n").alias("_all_plays"))
    listed = ", ".join(f"{float(t)!r}D" for t in trims)
    return (
        placed.join(F.broadcast(totals), groups)
        .selectExpr("*", f"explode(array({listed})) AS trim")
        .filter(
            "CASE WHEN trim <= 1 THEN _plays < _all_plays * (1 - trim)"
            " ELSE _place <= floor(trim) END"
        )
        .drop("_plays", "_place", "_all_plays")
    )


def first_points(curve: DataFrame, n: int) -> DataFrame:
    """The first ``n`` points of each curve. Spark keeps ``n`` per task before it shuffles."""
    window = Window.partitionBy("measure", "cohort").orderBy("key")
    place = F.row_number().over(window)
    return curve.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def linear_fit(curve: DataFrame, level: float = 0.95) -> DataFrame:
    """Straight-line fit of each curve: slope, intercept, residual sd and chi-square.

    ``t_value`` is the t quantile of the confidence ``level`` for the curve's own number of points less 2,
    NULL for curves of up to two points. Chi-square divides the squared residuals by the squared variance of the points, as defined
    for this report.
    """
    x, y = "CAST(key AS DOUBLE)", "fit_mean"
    parts = curve.groupBy("measure", "cohort").agg(
        F.expr(f"regr_count({y}, {x})").alias("points"),
        F.expr(f"regr_slope({y}, {x})").alias("slope"),
        F.expr(f"regr_intercept({y}, {x})").alias("intercept"),
        F.expr(f"regr_avgx({y}, {x})").alias("mean_x"),
        F.expr(f"regr_sxx({y}, {x})").alias("sxx"),
        F.expr(f"regr_syy({y}, {x})").alias("_syy"),
        F.expr(f"regr_sxy({y}, {x})").alias("_sxy"),
    )
    return (
        parts.selectExpr(
            "*",
            "greatest(_syy - try_divide(_sxy * _sxy, sxx), 0D) AS _residual",
            "try_divide(_syy, points) AS _variance",
        )
        .selectExpr("*", "try_divide(_residual, _variance * _variance) AS chi_square")
        .selectExpr(
            *("measure", "cohort", "points", "slope", "intercept", "mean_x", "sxx"),
            "sqrt(try_divide(_residual, points - 2)) AS residual_sd",
            "chi_square",
            "try_divide(chi_square, points - 2) AS reduced_chi_square",
            f"{t_quantile(level, 'points - 2')} AS t_value",
        )
    )


def fit_bands(curve: DataFrame, level: float = 0.95, points: int = 100) -> DataFrame:
    """Confidence and prediction bands of the fit at evenly spaced keys."""
    groups = ["measure", "cohort"]
    ends = curve.groupBy(*groups).agg(
        F.min("key").cast("double").alias("_first"), F.max("key").cast("double").alias("_last")
    )
    # One row per curve on either side.
    return (
        linear_fit(curve, level)
        .join(F.broadcast(ends), groups)
        .selectExpr("*", f"explode(sequence(0, {points - 1})) AS point")
        .selectExpr("*", f"_first + point * ((_last - _first) / {points - 1}) AS x")
        .selectExpr(
            "*",
            "intercept + slope * x AS fitted",
            "1D / points + try_divide((x - mean_x) * (x - mean_x), sxx) AS _spread",
        )
        .selectExpr(
            *("measure", "cohort", "point", "x", "fitted"),
            "fitted - t_value * residual_sd * sqrt(_spread) AS confidence_lo",
            "fitted + t_value * residual_sd * sqrt(_spread) AS confidence_hi",
            "fitted - t_value * residual_sd * sqrt(1 + _spread) AS prediction_lo",
            "fitted + t_value * residual_sd * sqrt(1 + _spread) AS prediction_hi",
        )
    )


def missing(df: DataFrame, needs: Iterable[str]) -> list[str]:
    """Required columns that the frame lacks; looks at the schema only."""
    return [c for c in needs if c not in df.columns]
