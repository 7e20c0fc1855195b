"""Numbering and counting rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.hotkeys import ROWS, SALT, HotKeys, hot_keys, list_hot, salted
from cohortlens.operators.prefix import sliced_totals


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    number: str,
    total: str | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Number the rows of each key from 1 along ``order``, and optionally count them.

    Ordinary keys take one shuffle on ``keys``, for the number and the count together. Rows of
    hot keys are spread over slices instead. ``order`` has to be unique within a key.
    """
    hot = hot_keys(df, keys) if hot is None else hot
    if not hot:
        return _number_in_window(df, keys, order, number, total)
    ordinary, crowded = hot.split(df)
    numbered = sliced_totals(crowded, keys, order, {number: F.lit(1)}, hot.total_rows)
    if total:
        counts = crowded.groupBy(*keys).agg(F.count(F.lit(1)).alias(total))
        numbered = numbered.join(hot.hinted(counts), list(keys))
    return _number_in_window(ordinary, keys, order, number, total).unionByName(numbered)


def _number_in_window(df, keys, order, number, total):
    per_key = Window.partitionBy(*keys)
    columns = [F.row_number().over(per_key.orderBy(*order)).cast("long").alias(number)]
    if total:
        columns.append(F.count(F.lit(1)).over(per_key).alias(total))
    return df.select("*", *columns)


def count_rows(
    df: DataFrame, keys: Sequence[str], total: str, hot: HotKeys | None = None
) -> DataFrame:
    """Add the row count of the row's key.

    Ordinary keys are counted by a window, after one shuffle on ``keys``. Hot keys are counted
    map-side, and their rows are spread over all tasks instead of being gathered.
    """
    hot = hot_keys(df, keys) if hot is None else hot
    if not hot:
        return df.select("*", F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias(total))
    listed = hot.listed()
    counts = df.join(listed, list(keys), "left_semi").groupBy(*keys)
    known = counts.agg(F.count(F.lit(1)).alias("_known"))
    spread = salted(df, hot, listed.join(hot.hinted(known), list(keys), "left"))
    in_window = F.count(F.lit(1)).over(Window.partitionBy(*keys, SALT))
    return spread.select(*df.columns, F.coalesce(F.col("_known"), in_window).alias(total))


def count_results(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results per ``keys``, NULL among them, for ranks by these or fewer keys."""
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS))


def rank_results(
    results: DataFrame,
    keys: Sequence[str],
    number: str = "nth",
    min_rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Session number of every result: its rank by ``id`` among the results of ``keys``.

    Results with one ``id`` share a rank, however many results the key has. NULL is a key like any
    other, and may be a hot one. ``counts`` (``count_results``) spares the pass that looks for hot keys.
    """
    known = {f"_key{i}": F.coalesce(F.col(k), F.lit(0)) for i, k in enumerate(keys)}
    known |= {f"_none{i}": F.col(k).isNull() for i, k in enumerate(keys)}
    frame, safe = results.withColumns(known), list(known)
    if counts is None:
        hot = hot_keys(frame, safe, min_rows)
    else:
        per_key = counts.withColumns(known).groupBy(*safe).agg(F.sum(ROWS).alias(ROWS))
        hot = list_hot(per_key, safe, min_rows)
    ordinary, crowded = hot.split(frame) if hot else (frame, None)
    in_window = F.rank().over(Window.partitionBy(*safe).orderBy("id"))
    ranked = ordinary.select("*", in_window.cast("long").alias(number))
    if crowded is not None:
        # Each id once, with the number of results that have it.
        ids = crowded.groupBy(*safe, "id").agg(F.count(F.lit(1)).alias("_same"))
        upto = sliced_totals(ids, safe, ["id"], {"_upto": F.col("_same")}, hot.total_rows)
        first = upto.select(*safe, "id", (F.col("_upto") - F.col("_same") + 1).alias(number))
        ranked = ranked.unionByName(crowded.join(first, [*safe, "id"]))
    return ranked.drop(*safe)
