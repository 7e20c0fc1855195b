"""Comparing the distribution of a value in both cohorts.

Everything is computed from a frequency table (``metric, cohort, value, n``), so plays are
counted before they are moved and several metrics share each pass. What is known about a
frequency table as a whole (ranges, sizes; two rows per metric) is looked up first: ``Profile``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cohortlens.functions import ks_p_value, per_cohort, percent
from cohortlens.model import COHORTS
from cohortlens.operators.prefix import running_totals
from cohortlens.session import constants

SIGNIFICANCE = 0.05


@dataclass(frozen=True)
class Cut:
    """Upper limit for the values of a metric; a factor of 0 or less switches it off.

    ``mean_sd``: value <= mean + k sd. ``sd``: value < k sd. ``cap``: value <= k.
    """

    kind: str = "none"
    k: tuple[float, float] = (0, 0)

    def _on(self) -> dict[int, float]:
        if self.kind == "none":
            return {}
        return {c: float(k) for c, k in zip(COHORTS, self.k) if k > 0}

    def limit(self) -> str:
        k = per_cohort(self._on())
        return {"mean_sd": f"mean + {k} * sd", "sd": f"{k} * sd"}.get(self.kind, k)

    def keeps(self) -> str:
        """Rows that stay. With a switched-on cut, a NULL value or NULL limit keeps nothing."""
        on = self._on()
        if not on:
            return "true"
        inside = "value < cutoff" if self.kind == "sd" else "value <= cutoff"
        return f"(cohort NOT IN ({', '.join(map(str, on))}) OR {inside})"


# --- values ----------------------------------------------------------------------------------

# Per-user aggregates, with the columns they need.
USER_AGGREGATES = {
    "plays": ("max(session_count)", ("session_count",)),
    "longest": ("max(playtime)", ("playtime",)),
    "shortest": ("min(playtime)", ("playtime",)),
    "correct": ("avg(numcorrect)", ("numcorrect",)),
    "tries": ("avg(numtries)", ("numtries",)),
    "jump": ("avg(user_level - session_level)", ("user_level", "session_level")),
    "score": ("avg(score)", ("score",)),
}

# Percent correct from the user's two means, rounded half to even.
PERCENT_PER_USER = f"bround({percent('correct', 'tries')})"


def per_user(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """One row per cohort and user; hash aggregation combines a user's plays map-side."""
    if names is None:
        names = [n for n, (_, needs) in USER_AGGREGATES.items() if set(needs) <= set(df.columns)]
    return df.groupBy("cohort", "user_id").agg(
        *[F.expr(USER_AGGREGATES[n][0]).alias(n) for n in names]
    )


def user_values(users: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """Long form: ``metric, cohort, value``, one row per user and metric."""
    entries = [
        f"struct('{metric}' AS metric, CAST({value} AS DOUBLE) AS value)"
        for metric, value in values.items()
    ]
    return users.selectExpr("cohort", f"inline(array({', '.join(entries)}))")


SUMMARIES = ("min", "max", "avg", "stddev_samp")


def with_cutoff(
    users: DataFrame, values: Mapping[str, str], cuts: Mapping[str, Cut]
) -> DataFrame:
    """Summary per metric and cohort: users, range, mean, sd and the cutoff that follows.

    All metrics are summed up side by side, one row per user, and the two rows that are left are unfolded.
    """
    columns = {metric: f"CAST({value} AS DOUBLE)" for metric, value in values.items()}
    wide = users.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.expr(f"{how}({value})").alias(f"{metric}_{how}")
            for metric, value in columns.items()
            for how in SUMMARIES
        ],
    )
    entries = [
        f"struct('{m}' AS metric, {m}_min AS min, {m}_max AS max, {m}_avg AS mean,"
        f" {m}_stddev_samp AS sd)"
        for m in values
    ]
    summary = wide.selectExpr("cohort", "total", f"inline(array({', '.join(entries)}))").select(
        "metric", "cohort", "total", "min", "max", "mean", "sd"
    )
    return summary.selectExpr("*", f"CAST({_by_metric(cuts, Cut.limit)} AS DOUBLE) AS cutoff")


def _by_metric(cuts: Mapping[str, Cut], text) -> str:
    cases = " ".join(f"WHEN '{metric}' THEN {text(cut)}" for metric, cut in cuts.items())
    return f"CASE metric {cases} END"


def user_frequencies(
    values: DataFrame, summary: DataFrame, cuts: Mapping[str, Cut]
) -> DataFrame:
    """How many users have each value, after the cut."""
    # The summary has two rows per metric.
    limits = F.broadcast(summary.select("metric", "cohort", "cutoff"))
    return (
        values.join(limits, ["metric", "cohort"])
        .filter(f"value IS NOT NULL AND {_by_metric(cuts, Cut.keeps)}")
        .groupBy("metric", "cohort", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def play_frequencies(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """How many plays have each value of a column, for ``{metric: column}``."""
    parts = [
        df.filter(F.col(column).isNotNull())
        .groupBy("cohort", F.col(column).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(metric).alias("metric"), "cohort", "value", "n")
        for metric, column in columns.items()
    ]
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    return combined


def play_summary(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("metric", "cohort").agg(
        F.sum("n").alias("total"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.expr("try_divide(sum(n * value), sum(n))").alias("mean"),
        F.lit(None).cast("double").alias("sd"),
        F.lit(None).cast("double").alias("cutoff"),
    )


def exclusions(frequencies: DataFrame, summary: DataFrame) -> DataFrame:
    """How many values the cut took out."""
    kept = frequencies.groupBy("metric", "cohort").agg(F.sum("n").alias("_kept"))
    # Two rows per metric.
    return summary.join(F.broadcast(kept), ["metric", "cohort"], "left").selectExpr(
        *("metric", "cohort", "total"),
        "total - coalesce(_kept, 0) AS excluded",
        *("min", "max", "mean", "cutoff"),
    )


# --- what is known about a frequency table ------------------------------------------------------


def bin_count(lowest: float, highest: float) -> int:
    """Fixed rule: 10 bins below a span of 20, 20 bins below 30, else 30."""
    span = int(highest - lowest) + 1
    return 10 if span < 20 else 20 if span < 30 else 30


def _widen(lowest: float, highest: float) -> tuple[float, float]:
    """A range of one point is widened by half a unit on both sides."""
    return (lowest - 0.5, highest + 0.5) if lowest == highest else (lowest, highest)


@dataclass(frozen=True)
class Profile:
    """Range, size and norm of each metric and cohort: two rows per metric, on the driver."""

    rows: tuple[Row, ...]

    DDL = (
        "metric string, cohort int, size bigint, bins int, own_from double, own_to double,"
        " shared_from double, shared_to double, norm double"
    )

    @classmethod
    def of(cls, frequencies: DataFrame) -> Profile:
        found = frequencies.groupBy("metric", "cohort").agg(
            F.min("value").alias("lowest"),
            F.max("value").alias("highest"),
            F.sum("n").alias("size"),
            F.count(F.lit(1)).alias("values"),
            F.expr("sqrt(sum(n * value * value))").alias("norm"),
        )
        return cls(tuple(found.collect()))

    def of_metric(self, metric: str) -> list[Row]:
        return [row for row in self.rows if row["metric"] == metric]

    def constant(self, metric: str) -> bool:
        """Whether all values of a cohort are the same."""
        return any(row["lowest"] == row["highest"] for row in self.of_metric(metric))

    def without(self, metrics: Iterable[str]) -> Profile:
        left_out = set(metrics)
        return Profile(tuple(row for row in self.rows if row["metric"] not in left_out))

    def largest(self) -> int:
        """Most distinct values that any metric can have."""
        totals: dict[str, int] = {}
        for row in self.rows:
            totals[row["metric"]] = totals.get(row["metric"], 0) + row["values"]
        return max(totals.values(), default=0)

    def frame(self, like: DataFrame) -> DataFrame:
        """The rows with bin ranges. The norm keeps 12 digits: its last ones depend on the
        order of summation, and equal samples have to stay equal."""
        rows = []
        for row in self.rows:
            both = self.of_metric(row["metric"])
            lowest = min(r["lowest"] for r in both)
            highest = max(r["highest"] for r in both)
            rows.append(
                (
                    row["metric"],
                    row["cohort"],
                    row["size"],
                    bin_count(lowest, highest),
                    *_widen(row["lowest"], row["highest"]),
                    *_widen(lowest, highest),
                    float(f"{row['norm']:.11e}") or 1.0,
                )
            )
        return constants(like.sparkSession, rows, self.DDL)


# --- histograms ------------------------------------------------------------------------------


def _edge(name: str, i: str) -> str:
    return (
        f"IF({i} = bins, {name}_to, {name}_from + ({i}) * (({name}_to - {name}_from) / bins))"
    )


def _guess(name: str) -> str:
    """Bin of ``value`` by its distance from the start; rounding can make it one off."""
    extent = f"({name}_to - {name}_from)"
    return f"least(floor((value - {name}_from) * bins / {extent}), bins - 1L) AS _{name}"


def _settle(name: str) -> str:
    """The guessed bin, with the bin edges having the last word. Bins are closed on the left,
    and the last one on both sides."""
    guess = f"_{name}"
    return (
        f"{guess} - IF(value < {_edge(name, guess)}, 1, 0)"
        f" + IF({guess} < bins - 1 AND value >= {_edge(name, guess + ' + 1')}, 1, 0)"
    )


def histograms(frequencies: DataFrame, profile: Profile) -> DataFrame:
    """Counts over each cohort's own range, and counts and density over the shared range.

    One pass over the frequencies and one shuffle of at most a row per bin and task.
    """
    keys = ["metric", "cohort"]
    ranges = profile.frame(frequencies)
    placed = (
        frequencies.join(ranges, keys)
        .selectExpr("*", _guess("own"), _guess("shared"))
        .selectExpr(
            *keys,
            f"inline(array(struct({_settle('own')} AS bin, n AS own_n, 0L AS shared_n),"
            f" struct({_settle('shared')} AS bin, 0L AS own_n, n AS shared_n)))",
        )
    )
    grid = ranges.selectExpr(
        *keys, "explode(sequence(0L, bins - 1L)) AS bin", "0L AS own_n", "0L AS shared_n"
    )
    counted = (
        placed.unionByName(grid)
        .groupBy(*keys, "bin")
        .agg(F.sum("own_n").alias("own_count"), F.sum("shared_n").alias("shared_count"))
    )
    return counted.join(ranges, keys).selectExpr(
        *keys,
        "bin",
        f"{_edge('own', 'bin')} AS own_lo",
        f"{_edge('own', 'bin + 1')} AS own_hi",
        "own_count",
        f"{_edge('shared', 'bin')} AS shared_lo",
        f"{_edge('shared', 'bin + 1')} AS shared_hi",
        "shared_count",
        "shared_count / (size * ((shared_to - shared_from) / bins)) AS density",
    )


# --- Kolmogorov-Smirnov ----------------------------------------------------------------------


def unit_norm(frequencies: DataFrame, profile: Profile) -> DataFrame:
    """Values divided by the Euclidean norm of all values of their metric and cohort."""
    norms = profile.frame(frequencies).select("metric", "cohort", "norm")
    scaled = frequencies.join(norms, ["metric", "cohort"])
    return scaled.selectExpr("metric", "cohort", "value / norm AS value", "n")


# Samples up to this size get an exact p-value.
EXACT_ROWS = 10_000


def exact_p_values(found: DataFrame) -> DataFrame:
    """Fill ``p`` where ``gap``, the distance times both sample sizes, is given.

    Each order of the pooled values is equally likely, so a walk through them takes its next step from a
    sample with the probability of its share in what is left. All walks go on together, one value at a
    time; p is what leaves the band in which the distance stays under the one found. Only positive
    numbers are added, so small p keep their digits. One row per test: its walk is a helper of a few
    vectors, and tests are spread over tasks.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def outside(m: int, n: int, gap: int) -> float:
            if not gap:
                return 1.0
            whole, left_band = m + n, 0.0
            low, inside = 0, np.ones(1)  # by how many of the steps were of the first sample
            for step in range(whole):
                first = np.arange(low, low + len(inside))
                ahead = np.zeros(len(inside) + 1)
                ahead[:-1] = inside * ((n - step + first) / (whole - step))
                ahead[1:] += inside * ((m - first) / (whole - step))
                # The band of the next step, |i / m - j / n| < gap / (m n), in whole numbers.
                centre = (step + 1) * m
                start = max((centre - gap) // whole + 1, step + 1 - n, 0)
                stop = min(-(-(centre + gap) // whole), step + 2, m + 1)
                left_band += ahead[: start - low].sum() + ahead[max(stop - low, 0) :].sum()
                low, inside = start, ahead[start - low : stop - low]
                if not len(inside):
                    break
            return min(float(left_band), 1.0)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n1", "n2", "gap", "p")]
            p = [p if gap is None else outside(n1, n2, gap) for n1, n2, gap, p in zip(*columns, strict=True)]
            at = batch.schema.get_field_index("p")
            yield batch.set_column(at, "p", pa.array(p, pa.float64()))

    return found.mapInArrow(run, found.schema)


def ks_tests(
    frequencies: DataFrame,
    profile: Profile,
    window_rows: int | None = None,
    exact_rows: int | None = None,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov tests, one row per metric.

    Is the distribution the same? Is its shape (after scaling each sample to unit norm)? ``method`` says
    how p was found: exact if both samples have at most ``exact_rows`` values, else asymptotic.
    """
    exact_rows = EXACT_ROWS if exact_rows is None else exact_rows
    both = ["metric", "variant"]
    ranges = profile.frame(frequencies).select("metric", "cohort", "norm")
    counts = (
        frequencies.join(ranges, ["metric", "cohort"])
        .selectExpr(
            "metric",
            "inline(array(struct('value' AS variant, value AS value),"
            " struct('shape' AS variant, value / norm AS value)))",
            "IF(cohort = 1, n, 0L) AS n1",
            "IF(cohort = 2, n, 0L) AS n2",
        )
        .groupBy(*both, "value")
        .agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    )
    small = f"least(n1, n2) > 0 AND greatest(n1, n2) <= {exact_rows}"
    running = running_totals(
        counts,
        both,
        ["value"],
        {"_f1": F.col("n1"), "_f2": F.col("n2")},
        window_rows,
        largest=profile.largest(),
        rows=2 * sum(row["values"] for row in profile.rows),
    )
    found = (
        running.drop("n1", "n2")
        .join(_sizes(frequencies, profile), "metric")
        .groupBy(*both, "n1", "n2")
        .agg(
            F.expr("max(abs(try_divide(_f1, n1) - try_divide(_f2, n2)))").alias("d"),
            F.expr(f"max(IF({small}, abs(_f1 * n2 - _f2 * n1), NULL))").alias("gap"),
        )
        .selectExpr("*", f"{ks_p_value('d', 'n1', 'n2')} AS p")
    )
    # Whether any test can be exact is known from the profile, before anything runs.
    if any(0 < row["size"] <= exact_rows for row in profile.rows):
        found = exact_p_values(found)
    values = ("n1", "n2", "d", "p")
    shaped = [f"max(IF(variant = 'value', {c}, NULL)) AS {c}" for c in values]
    shaped += [f"max(IF(variant = 'shape', {c}, NULL)) AS shape_{c}" for c in ("d", "p")]
    return (
        found.groupBy("metric")
        .agg(*[F.expr(text) for text in shaped])
        .selectExpr(
            *("metric", "n1", "n2", "d", "p AS p_value", "shape_d", "shape_p AS shape_p_value"),
            f"p >= {SIGNIFICANCE}D AS same_distribution",
            f"shape_p >= {SIGNIFICANCE}D AS same_shape",
            f"CASE WHEN {small} THEN 'exact' WHEN p IS NOT NULL THEN 'asymptotic' END AS method",
        )
    )


def _sizes(like: DataFrame, profile: Profile) -> DataFrame:
    """Sample sizes, one row per metric."""
    sizes: dict[str, dict[int, int]] = {}
    for row in profile.rows:
        sizes.setdefault(row["metric"], {})[row["cohort"]] = row["size"]
    rows = [(m, *(found.get(c, 0) for c in COHORTS)) for m, found in sizes.items()]
    return constants(like.sparkSession, rows, "metric string, n1 bigint, n2 bigint")
