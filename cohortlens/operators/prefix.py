"""Running totals over an order, for groups of any size."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import materialise

# Largest group that one window task may hold.
WINDOW_ROWS = 1_000_000
# Rows aimed at per slice when a group is cut into slices.
SLICE_ROWS = 500_000

SLICE = "_slice"


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    window_rows: int | None = None,
    largest: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add inclusive running sums along ``order`` within each group of ``by``.

    ``order`` has to be unique within a group. If the largest group fits one task, a plain window
    does it; otherwise the groups are cut (see ``sliced_totals``). A caller that knows how many
    rows the largest group and the frame can have says so, else they are counted first.
    """
    window_rows = WINDOW_ROWS if window_rows is None else window_rows
    if largest is None:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        largest, rows = sizes.agg(F.max("n"), F.sum("n")).first()
    if (largest or 0) > window_rows:
        return sliced_totals(df, by, order, sums, rows)
    running = _running(Window.partitionBy(*by), order)
    return df.select("*", *[F.sum(value).over(running).alias(out) for out, value in sums.items()])


def sliced_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    rows: int,
) -> DataFrame:
    """Running sums for groups larger than a task.

    The rows are range partitioned on group and order, so a group is spread over neighbouring
    slices, whatever its size. Sums run within each slice, and what earlier slices of the group
    add up to is joined back. Only a group that began in an earlier slice needs that offset, and
    each slice has at most one such group: the broadcast side has fewer rows than there are
    slices.
    """
    by, order = list(by), list(order)
    slices = slice_count(df, rows)
    sliced = materialise(
        df.repartitionByRange(slices, *by, *order).withColumn(SLICE, F.spark_partition_id())
    )
    inside = _running(Window.partitionBy(*by, SLICE), order)
    local = sliced.select(
        "*", *[F.sum(value).over(inside).alias(out) for out, value in sums.items()]
    )
    totals = sliced.groupBy(*by, SLICE).agg(
        *[F.sum(value).alias(f"_sum_{out}") for out, value in sums.items()]
    )
    before = (
        Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *by,
        SLICE,
        F.row_number().over(Window.partitionBy(*by).orderBy(SLICE)).alias("_nth_slice"),
        *[F.sum(f"_sum_{out}").over(before).alias(f"_before_{out}") for out in sums],
    ).filter(F.col("_nth_slice") > 1)
    joined = local.join(F.broadcast(offsets), [*by, SLICE], "left")
    return joined.select(
        *df.columns,
        *[
            (F.col(out) + F.coalesce(F.col(f"_before_{out}"), F.lit(0))).alias(out)
            for out in sums
        ],
    )


def slice_count(df: DataFrame, rows: int) -> int:
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, math.ceil(rows / SLICE_ROWS))


def _running(window, order: Sequence[str]):
    return window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
