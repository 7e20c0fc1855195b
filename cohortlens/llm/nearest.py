"""Approximate nearest neighbours: a navigable small-world graph per shard, results merged.

Distinct vectors are dealt into shards of bounded size by hash. Each shard builds a hierarchical graph, which
is stored as flat neighbour arrays, one row per node and level. Blocks of queries are searched in
every shard's graph; each block's results are merged by distance. Equal vectors are one node; the rows
that share it are put back after the search, as many as can be among the nearest.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import ship_code, staged, table

K = 10
QUERY_EVERY = 100
# Vectors in a shard, on average.
SHARD_ROWS = 8_192
# Queries that are searched in one copy of a shard.
BLOCK = 4_096
# Neighbours of a node on the upper levels (twice as many on the lowest), and how many nodes are
# kept in view when a node is added, and when a query is searched.
LINKS = 16
BUILD_VIEW = 64
SEARCH_VIEW = 128


class Graph:
    """Nodes by level with flat neighbour arrays: ``near[level][node]`` is padded with -1."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray) -> None:
        self.vectors = vectors
        self.levels = levels
        top = int(levels.max(initial=0))
        self.near = [
            np.full((len(vectors), 2 * LINKS if level == 0 else LINKS), -1, np.int32)
            for level in range(top + 1)
        ]
        self.degree = [np.zeros(len(vectors), np.int32) for _ in range(top + 1)]
        self.entry = -1

    @classmethod
    def built(cls, vectors: np.ndarray, levels: np.ndarray) -> Graph:
        graph = cls(vectors, levels)
        for node in range(len(vectors)):
            graph._add(node)
        return graph

    @classmethod
    def stored(cls, vectors: np.ndarray, levels: np.ndarray, flat: list[np.ndarray]) -> Graph:
        """From the rows of the index; ``flat[node]`` has the node's neighbours of all its levels."""
        graph = cls(vectors, levels)
        for node, own in enumerate(flat):
            at = 0
            for level in range(int(levels[node]) + 1):
                width = graph.near[level].shape[1]
                graph.near[level][node] = own[at : at + width]
                at += width
            if graph.entry < 0 or levels[node] > levels[graph.entry]:
                graph.entry = node
        for level, near in enumerate(graph.near):
            graph.degree[level] = (near >= 0).sum(1)
        return graph

    def flat(self, node: int) -> np.ndarray:
        return np.concatenate([self.near[level][node] for level in range(self.levels[node] + 1)])

    def _distances(self, vector: np.ndarray, nodes) -> np.ndarray:
        gap = self.vectors[nodes] - vector
        return np.einsum("ij,ij->i", gap, gap)

    def _add(self, node: int) -> None:
        if self.entry < 0:
            self.entry = node
            return
        vector, own = self.vectors[node], int(self.levels[node])
        top = int(self.levels[self.entry])
        start = [(float(self._distances(vector, [self.entry])[0]), self.entry)]
        for level in range(top, -1, -1):
            if level > own:
                start = self._layer(vector, start, 1, level)
                continue
            start = self._layer(vector, start, BUILD_VIEW, level)
            chosen = self._spread(start, LINKS)
            self.near[level][node, : len(chosen)] = chosen
            self.degree[level][node] = len(chosen)
            for other in chosen:
                self._link(other, node, level)
        if own > top:
            self.entry = node

    def _link(self, node: int, new: int, level: int) -> None:
        near, degree = self.near[level], self.degree[level]
        if degree[node] < near.shape[1]:
            near[node, degree[node]] = new
            degree[node] += 1
            return
        others = np.append(near[node], new)
        found = sorted(zip(self._distances(self.vectors[node], others).tolist(), others.tolist(), strict=True))
        chosen = self._spread(found, near.shape[1])
        near[node] = -1
        near[node, : len(chosen)] = chosen
        degree[node] = len(chosen)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours nearer to the node than to each other first, then the nearest of the rest."""
        if len(found) <= most:
            return [n for _, n in found]
        nodes = np.array([n for _, n in found])
        vectors = self.vectors[nodes]
        squares = np.einsum("ij,ij->i", vectors, vectors)
        between = squares[:, None] + squares - 2 * (vectors @ vectors.T)
        chosen: list[int] = []
        # Distance of each candidate to the nearest chosen one.
        closest = np.full(len(nodes), np.inf)
        for i, (distance, _) in enumerate(found):
            if distance < closest[i]:
                chosen.append(i)
                np.minimum(closest, between[i], out=closest)
                if len(chosen) == most:
                    break
        rest = iter(sorted(set(range(len(nodes))) - set(chosen)))
        chosen.extend(i for i, _ in zip(rest, range(most - len(chosen)), strict=False))
        return nodes[chosen].tolist()

    def _layer(
        self, vector: np.ndarray, start: list[tuple[float, int]], view: int, level: int
    ) -> list[tuple[float, int]]:
        """The ``view`` nearest nodes found on a level, nearest first."""
        near = self.near[level]
        seen = np.zeros(len(self.vectors), bool)
        seen[[n for _, n in start]] = True
        ahead = list(start)
        heapq.heapify(ahead)
        found = [(-d, n) for d, n in start]
        heapq.heapify(found)
        while ahead:
            distance, node = heapq.heappop(ahead)
            if distance > -found[0][0] and len(found) >= view:
                break
            others = near[node]
            others = others[others >= 0]
            others = others[~seen[others]]
            if not len(others):
                continue
            seen[others] = True
            distances = self._distances(vector, others)
            if len(found) >= view:
                closer = distances < -found[0][0]
                others, distances = others[closer], distances[closer]
            for d, n in zip(distances.tolist(), others.tolist(), strict=True):
                if len(found) < view:
                    heapq.heappush(found, (-d, n))
                elif d < -found[0][0]:
                    heapq.heapreplace(found, (-d, n))
                else:
                    continue
                heapq.heappush(ahead, (d, n))
        return sorted((-d, n) for d, n in found)

    def search(self, vector: np.ndarray, view: int) -> list[int]:
        """Up to ``view`` nodes, about the nearest ones."""
        if self.entry < 0:
            return []
        start = [(float(self._distances(vector, [self.entry])[0]), self.entry)]
        for level in range(int(self.levels[self.entry]), 0, -1):
            start = self._layer(vector, start, 1, level)
        return [n for _, n in self._layer(vector, start, view, 0)]


def drawn_levels(ids: np.ndarray) -> np.ndarray:
    """Levels by the hash of the node's id, each LINKS times rarer than the one below; the same on each run."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    unit = ((mixed >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
    return np.minimum(-np.log(unit) / np.log(LINKS), 8).astype(np.int32)


# -- Spark -------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows that take part.

    Left out are vectors that are null, empty, zero, or hold null or non-finite components.
    """
    ship_code(vectors.sparkSession)
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), fine.alias("fine"))
        .where(F.col("vec_id").isNotNull() & F.col("fine") & F.exists("vector", lambda x: x != 0))
        .select("vec_id", "vector")
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


INDEX = "dim int, shard int, node bigint, level int, neighbours array<int>, vector array<double>"


def build_index(nodes: DataFrame, shards: int) -> DataFrame:
    """The graphs of all shards: per node its level, its flat neighbours and its vector.

    ``nodes`` has ``node`` (an id) and ``vector``. Vectors of other lengths are in graphs of their own.
    """
    dealt = nodes.select(
        F.size("vector").alias("dim"),
        F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"),
        "node",
        "vector",
    )

    def build(found: pa.Table) -> pa.Table:
        found = found.sort_by("node")
        vectors = _matrix(found["vector"])
        levels = drawn_levels(found["node"].to_numpy())
        graph = Graph.built(vectors.astype(np.float32), levels)
        flat = [graph.flat(i) for i in range(len(vectors))]
        columns = {
            "dim": found["dim"], "shard": found["shard"], "node": found["node"],
            "level": pa.array(levels), "neighbours": pa.array(flat, pa.list_(pa.int32())),
            "vector": found["vector"],
        }
        return pa.table(columns)

    return dealt.groupBy("dim", "shard").applyInArrow(build, INDEX)


FOUND = "query_id bigint, node bigint, score double"
FOUND_ARROW = pa.schema(
    [("query_id", pa.int64()), ("node", pa.int64()), ("score", pa.float64())]
)


def searched(queries: DataFrame, index: DataFrame, shards: int, k: int = K) -> DataFrame:
    """Per query and shard the ``k + 1`` nearest nodes found, with exact distances.

    Every shard is searched for every query, in blocks of queries; one row more than asked for,
    as a query may find itself.
    """
    blocks = 1 + queries.count() // BLOCK
    asked = queries.select(
        F.size("vector").alias("dim"),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        "query_id",
        "vector",
    )
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "node": [], "score": []}
        if asked.num_rows and held.num_rows:
            held = held.sort_by("node")
            vectors, ids = _matrix(held["vector"]), held["node"].to_numpy()
            flat = [np.array(row, np.int32) for row in held["neighbours"].to_pylist()]
            graph = Graph.stored(vectors.astype(np.float32), held["level"].to_numpy(), flat)
            wanted = _matrix(asked["vector"])
            for query_id, vector in zip(asked["query_id"].to_pylist(), wanted, strict=True):
                nodes = np.array(graph.search(vector.astype(np.float32), max(SEARCH_VIEW, 2 * k)))
                exact = np.sqrt(((vectors[nodes] - vector) ** 2).sum(1))
                best = np.lexsort((ids[nodes], exact))[: k + 1]
                out["query_id"] += [query_id] * len(best)
                out["node"] += ids[nodes[best]].tolist()
                out["score"] += exact[best].tolist()
        return pa.table(out, schema=FOUND_ARROW)

    keys = ("dim", "shard", "block")
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(find, FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Each query's ``k`` nearest rows found, itself left out, nearest first, ties to smaller ids.

    ``vectors`` has ``vec_id`` and ``embedding``; ``queries`` is a part of it. Rows with equal vectors are
    one node of the graph; of each node the ``k + 1`` smallest ids are put back, which is all that
    can be among the nearest. Vectors of another length are no candidates. Rows that are not
    usable, null ids among them, take no part; repeated ids are candidates once for each distinct
    vector, and of a repeated query id the smallest vector is asked for. Empty tables give no rows. Columns with other names are not looked at.
    """
    rows = staged(usable(vectors).dropDuplicates(["vec_id", "vector"]))
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), "vector")
    asked = staged(asked.groupBy("query_id").agg(F.min("vector").alias("vector")))
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    nodes = rows.groupBy("vector").agg(F.min("vec_id").alias("node"))
    # One id can hold two vectors; a node's id must be its own, so such nodes get negative ids.
    turn = F.row_number().over(Window.partitionBy("node").orderBy("vector"))
    nodes = staged(
        nodes.withColumn("turn", turn).select(
            F.when(F.col("turn") == 1, F.col("node"))
            .otherwise(-F.abs(F.xxhash64("vector")) - 1)
            .alias("node"),
            "vector",
        )
    )
    shards = 1 + nodes.count() // SHARD_ROWS
    index = staged(build_index(nodes, shards))
    found = searched(asked, index, shards, k)
    order = Window.partitionBy("query_id").orderBy("score", "node")
    best = staged(
        found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")
    )
    # The smallest ids of each node that was found; first per part of its rows, then of all.
    wanted = best.select("node").distinct().join(nodes, "node")
    members = rows.join(wanted, "vector").select("node", "vec_id", spread.alias("part"))
    for keys in (("node", "part"), ("node",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        members = members.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        best.join(members.select("node", "vec_id"), "node")
        .where("vec_id != query_id")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))
