"""Connected components of links kept as a table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import release, staged


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for links ``a``, ``b``.

    In turn, each node's larger neighbours, and each node with its smaller ones, are linked to
    the smallest neighbour, until nothing changes; what is left is one star per component. A
    node's neighbours are only ever reduced to a minimum, never gathered; each round is written to the
    shared folder. Links of a node with itself and repeated links change nothing.
    """
    links = _ordered(links)
    state, old = None, []
    while True:
        large = staged(_large_star(links))
        links = staged(_small_star(large))
        release(large, *old)
        old = [links]
        found = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("sum")
        ).first()
        if state == (found.n, found["sum"]):
            break
        state = (found.n, found["sum"])
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root"), F.col("root"))).distinct()


def _ordered(links: DataFrame) -> DataFrame:
    """Links with ``a`` above ``b``."""
    return links.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")).select(
        "of", F.least("of", "m").alias("m")
    )
    # Each larger neighbour of a node goes to the node's least neighbour.
    return _ordered(
        links.join(least, F.col("b") == F.col("of")).select(F.col("a"), F.col("m").alias("b"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
    # Each smaller neighbour of a node, and the node, go to its least neighbour.
    beside = links.join(least, F.col("a") == F.col("of")).select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )
    own = least.select(F.col("of").alias("a"), F.col("m").alias("b"))
    return _ordered(beside.union(own))
