"""Schemas and parameters."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import types as T

COHORTS = (1, 2)
NUMBERINGS = ("observed", "true", "cross_game")

PLAYS = T.StructType(
    [
        T.StructField("game_result_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("game_id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("event_created_at", T.TimestampType()),
        T.StructField("user_level", T.IntegerType()),
        T.StructField("session_level", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("yyyy", T.IntegerType()),
        T.StructField("mm", T.IntegerType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("game_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
    ]
)

GAMES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("release_date", T.DateType()),
        T.StructField("game_version", T.StringType()),
    ]
)

# A selected cohort before cleaning: the measured values are still text.
SELECTED = T.StructType(
    [
        T.StructField("cohort", T.IntegerType()),
        T.StructField("game_result_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_created_at", T.TimestampType()),
        T.StructField("user_level", T.IntegerType()),
        T.StructField("session_level", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("numcorrect", T.StringType()),
        T.StructField("numtries", T.StringType()),
        T.StructField("playtime", T.StringType()),
    ]
)

CLEANED = T.StructType(
    [
        T.StructField("cohort", T.IntegerType()),
        T.StructField("game_result_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_created_at", T.TimestampType()),
        T.StructField("user_level", T.IntegerType()),
        T.StructField("session_level", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("numcorrect", T.DoubleType()),
        T.StructField("numtries", T.DoubleType()),
        T.StructField("playtime", T.DoubleType()),
        T.StructField("session_count", T.LongType()),
    ]
)


@dataclass(frozen=True)
class CompareParams:
    """All settings of one comparison. Pairs hold the value of cohort 1 and of cohort 2."""

    game_ids: tuple[int, int]
    report: str = "comparison"
    labels: tuple[str, str] = ("", "")

    # selection
    years: tuple[int, ...] | None = None
    months: tuple[int, int] | None = None
    versions: tuple[int | None, int | None] = (None, None)
    min_plays: int = 20
    exclude_other_game: tuple[bool, bool] = (False, False)
    numbering: tuple[str, str] = ("observed", "observed")
    age_unit: str | None = None
    age_lower: tuple[int, int] = (0, 0)
    age_upper: tuple[int, int] = (1, 1)
    age_boundary: bool = False
    as_of: datetime.date | None = None
    correct_label: tuple[str, str] = ("num_correct", "num_correct")
    tries_label: tuple[str, str] = ("num_tries", "num_tries")
    playtime_label: tuple[str, str] = ("playTime", "playTime")
    selected_level: bool = False

    # cleaning
    missing_items: int = -1
    min_performance: float = -1
    outlier_sigma: float = 0
    min_level_rows: int = 5
    min_sessions: int = 20

    # metrics
    fit_metrics: bool = True
    metrics: tuple[str, ...] | None = None
    time_sigma: tuple[float, float] = (0, 0)
    convergence_sessions: int = 3
    early_learning: tuple[float, ...] = (0.05, 20)
    plot_sigma: float = 3
    plays_cap: int = 20
    sample_users: int | None = None

    def __post_init__(self) -> None:
        unknown = set(self.numbering) - set(NUMBERINGS)
        if unknown:
            raise ValueError(f"numbering must be one of {NUMBERINGS}, not {sorted(unknown)}")

    @classmethod
    def create(
        cls,
        game_ids: Sequence[int],
        *,
        year: int | str | Sequence[int | str] | None = None,
        true_session: bool | Sequence[bool] = False,
        session_exclusion: bool | Sequence[bool] = False,
        today: datetime.date | None = None,
        **settings,
    ) -> CompareParams:
        """Accept the loose forms callers use and return one fixed form.

        ``year``: None, ``'all'`` or a list that starts with it means every year, 0 the current one; one
        year may stand without a list.
        A single flag stands for both cohorts, and numbering sessions across both games
        includes numbering them by the results log.
        """
        years = None
        if isinstance(year, (int, str)):
            year = [year]
        if year and year[0] != "all":
            current = (today or datetime.date.today()).year
            chosen = (int(y) for y in year if y != "all")
            years = tuple(dict.fromkeys(y or current for y in chosen))
        true_pair = _pair(true_session)
        cross_pair = _pair(session_exclusion)
        settings.setdefault(
            "numbering",
            tuple(
                "cross_game" if cross else "true" if true else "observed"
                for true, cross in zip(true_pair, cross_pair)
            ),
        )
        if "versions" in settings:
            settings["versions"] = tuple(v or None for v in settings["versions"])
        if not settings.get("months", None):
            settings["months"] = None
        if not settings.get("age_unit", None):
            settings["age_unit"] = None
        known = {f.name for f in fields(cls)}
        frozen = {k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()}
        unknown = set(frozen) - known
        if unknown:
            raise TypeError(f"unknown settings: {sorted(unknown)}")
        return cls(game_ids=tuple(game_ids), years=years, **frozen)

    def as_text(self) -> dict[str, str]:
        return {f.name: str(getattr(self, f.name)) for f in fields(self)}


def _pair(flag: bool | Sequence[bool]) -> tuple[bool, bool]:
    return (flag, flag) if isinstance(flag, bool) else tuple(flag)
