"""Finding the keys that hold too many rows for one task, and treating them apart."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import BROADCAST_ROWS, constants, materialise

# A key with more rows than this is numbered and joined without gathering it in one task.
HOT_ROWS = 1_000_000

ROWS = "_key_rows"


@dataclass(frozen=True)
class HotKeys:
    """The keys above a number of rows, as a table with their counts; None if there are none.

    Up to ``BROADCAST_ROWS`` keys are known to the driver and broadcast; more are a written table that
    joins shuffle as Spark sees fit.
    """

    keys: tuple[str, ...]
    table: DataFrame | None = None
    total_rows: int = 0
    few: bool = True

    def __bool__(self) -> bool:
        return self.table is not None

    def listed(self) -> DataFrame:
        return self.hinted(self.table.drop(ROWS))

    def hinted(self, facts: DataFrame) -> DataFrame:
        """A frame with at most one row per hot key, to be broadcast if the keys are few."""
        return F.broadcast(facts) if self.few else facts

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of ordinary keys, and rows of hot keys."""
        keys = list(self.keys)
        return df.join(self.listed(), keys, "left_anti"), df.join(self.listed(), keys, "left_semi")


def count_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key, combined map-side: one narrow row per key and task is moved."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS))


def list_hot(counts: DataFrame, keys: Sequence[str], min_rows: int | None = None) -> HotKeys:
    """The keys of ``counts`` above ``min_rows``."""
    min_rows = HOT_ROWS if min_rows is None else min_rows
    hot = counts.filter(F.col(ROWS) > min_rows)
    first = hot.limit(BROADCAST_ROWS + 1).collect()
    if not first:
        return HotKeys(tuple(keys))
    if len(first) <= BROADCAST_ROWS:
        table = constants(counts.sparkSession, first, counts.schema)
        return HotKeys(tuple(keys), table, sum(row[ROWS] for row in first))
    table = materialise(hot)
    return HotKeys(tuple(keys), table, table.agg(F.sum(ROWS)).first()[0], few=False)


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int | None = None) -> HotKeys:
    return list_hot(count_keys(df, keys), keys, min_rows)


# Rows of a hot key get a salt of their own from 1 up, all other rows get 0.
SALT = "_salt"


def salted(df: DataFrame, hot: HotKeys, facts: DataFrame) -> DataFrame:
    """Add SALT, and the columns of ``facts`` (at most one row per hot key) to hot rows.

    A shuffle on keys and SALT then spreads the rows of a hot key over all tasks.
    """
    columns = ", ".join(f"`{c}`" for c in df.columns)
    marked = df.join(hot.hinted(facts.withColumn("_hot", F.lit(True))), list(hot.keys), "left")
    salt = f"IF(_hot IS NULL, 0L, 1L + pmod(xxhash64({columns}), 2147483647L))"
    return marked.selectExpr("*", f"{salt} AS {SALT}").drop("_hot")


def filter_by_key(
    df: DataFrame, side: DataFrame, keys: Sequence[str], hot: HotKeys, matching: bool
) -> DataFrame:
    """Rows whose key is (or is not) in ``side``, which holds each key once.

    Spark chooses the join: sorted, which can spill, unless it finds ``side`` small enough to be hashed.
    """
    if not hot:
        return df.join(side, list(keys), "left_semi" if matching else "left_anti")
    marked = mark_by_key(df, side, keys, hot, "_present")
    return marked.filter("_present" if matching else "NOT _present").drop("_present")


def mark_by_key(
    df: DataFrame, side: DataFrame, keys: Sequence[str], hot: HotKeys, mark: str
) -> DataFrame:
    """Add ``mark``: whether the row's key is in ``side``, which holds each key once.

    Whether a hot key is in ``side`` is looked up first, and its salted rows match nothing wherever
    they are sent.
    """
    keys = list(keys)
    if not hot:
        marked = df.join(side.selectExpr(*keys, "true AS _joined"), keys, "left")
        present = "coalesce(_joined, false)"
    else:
        listed = hot.listed()
        found = side.join(listed, keys, "left_semi").withColumn("_looked_up", F.lit(True))
        facts = listed.join(hot.hinted(found), keys, "left")
        unsalted = side.selectExpr(*keys, f"0L AS {SALT}", "true AS _joined")
        marked = salted(df, hot, facts).join(unsalted, [*keys, SALT], "left")
        present = "coalesce(_joined, _looked_up, false)"
    return marked.select(*df.columns, F.expr(present).alias(mark))
