"""Hard negatives by inner product, found in cover trees over norm-augmented vectors.

Rows are dealt into trees of bounded size, rows of one label near each other. In a tree each vector x gets one
more component, sqrt(M^2 - |x|^2), so that all have the norm M and nearness is a larger inner product with
(a, 0). A node covers its points within a radius; the radius that its children may have is the power of
two below, centres of a level being farther apart than that. An angle and a covering radius bound the inner
product of an anchor with all points of a node, from above and from below.

Anchors descend best first. A node that no window of scores can use is skipped: it is above or below all of
them, or below what they have found already, or has only labels that don't count. Leaves are verified by
exact integer products. First each anchor's positives are found in the trees that can hold its label, then its
negatives in all trees, with one window for each positive. What trees return is merged by score and id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import ship_code, staged, table
from cohortlens.session import lookup

POSITIVES = 5
NEGATIVES = 10
# A negative's score lies between these hundredths of the positive's score.
WINDOW = (30, 90)
ANCHOR_EVERY = 100
# Components in a tree, on average: 4,096 vectors of 64 components.
TREE_VALUES = 1 << 18
# Anchors that are searched in one copy of a tree.
BLOCK = 4_096
# Points of a node that has no children.
LEAF = 24

LONG = (-(1 << 63), (1 << 63) - 1)
MIXED = -(1 << 40)  # a node with several labels; labels are ints


class CoverTree:
    """Points in the order of a tree, and its nodes as flat arrays.

    Node ``i`` covers the points ``low[i]`` to ``high[i]`` within ``radius[i]`` of the point ``centre[i]``, and
    its children are the nodes ``first[i]`` to ``last[i]``; a leaf has none.
    """

    ARRAYS = ("low", "high", "centre", "first", "last", "radius", "label")

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, nodes: dict) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        for name in self.ARRAYS:
            setattr(self, name, nodes[name])
        # Small components are multiplied as longs, others as Python's integers.
        most = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))
        self.small = most < 1 << 28 and vectors.shape[1] <= 1 << 6 or most < 1 << 20 and vectors.shape[1] <= 1 << 20
        self.norm = float(np.sqrt((vectors.astype(float) ** 2).sum(1).max(initial=0.0)))
        self.cos, self.sin = _cone(self.radius, self.norm)

    @classmethod
    def built(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> CoverTree:
        plain = vectors.astype(float)
        squares = (plain**2).sum(1)
        augmented = np.column_stack([plain, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0))])

        def distances(points: np.ndarray, centre: int) -> np.ndarray:
            gap = augmented[points] - augmented[centre]
            return np.sqrt(np.einsum("ij,ij->i", gap, gap))

        nodes: dict[str, list] = {name: [] for name in cls.ARRAYS}

        def add(low: int, points: np.ndarray, centre: int, far: np.ndarray) -> None:
            own = labels[points]
            values = (
                low, low + len(points), centre, 0, 0, far.max(),
                own[0] if (own == own[0]).all() else MIXED,
            )
            for name, value in zip(cls.ARRAYS, values, strict=True):
                nodes[name].append(value)
            waiting.append((len(nodes["low"]) - 1, points, far))

        order = np.arange(len(ids))
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(ids):
            add(0, order.copy(), 0, distances(order, 0))
        while waiting:
            node, points, far = waiting.pop()
            low, radius = nodes["low"][node], nodes["radius"][node]
            if len(points) <= LEAF or radius == 0:
                order[low : low + len(points)] = points
                continue
            within = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            nodes["first"][node] = len(nodes["low"])
            centre = nodes["centre"][node]
            while len(points):
                near = far <= within
                near[points == centre] = True
                add(low, points[near], centre, far[near])
                low += int(near.sum())
                points = points[~near]
                if len(points):
                    centre = int(points[0])
                    far = distances(points, centre)
            nodes["last"][node] = len(nodes["low"])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        found = {
            name: np.array(values, float if name == "radius" else np.int64) for name, values in nodes.items()
        }
        found["centre"] = place[found["centre"]]
        return cls(ids[order], labels[order], vectors[order], found)

    def products(self, points, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products, as longs (at the ends of their range if beyond it)."""
        if self.small and int(np.abs(anchor).max(initial=0)) < 1 << (28 if len(anchor) <= 1 << 6 else 20):
            return self.vectors[points] @ anchor
        exact = self.vectors[points].astype(object) @ anchor.astype(object)
        return np.array([min(max(int(v), LONG[0]), LONG[1]) for v in np.atleast_1d(exact)], np.int64)

    def bounds(self, nodes: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product that points of the nodes can have with the anchor."""
        most = float(np.sqrt((anchor.astype(float) ** 2).sum())) * self.norm
        slack = 1 + 1e-6 * most
        if not most:
            return np.full(len(nodes), -slack), np.full(len(nodes), slack)
        cos = np.clip(self.products(self.centre[nodes], anchor) / most, -1, 1)
        sin = np.sqrt(1 - cos * cos)
        wide, high = self.cos[nodes], self.sin[nodes]
        upper = np.where(wide <= cos, 1.0, cos * wide + sin * high)
        lower = np.where(wide <= -cos, -1.0, cos * wide - sin * high)
        return most * lower - slack, most * upper + slack

    def search(
        self, anchor: np.ndarray, own_id: int, label: int, same: bool, windows: list[tuple[int, int]], most: int
    ) -> list[list[tuple[int, int]]]:
        """Per window, the ``most`` best points (score, id) with a score in it, best first.

        Points have the anchor's label if ``same``, and another one if not.
        """
        least = np.array([w[0] for w in windows], np.int64)
        top = np.array([w[1] for w in windows], np.int64)
        scores = [np.zeros(0, np.int64) for _ in windows]
        ids = [np.zeros(0, np.int64) for _ in windows]

        def wanted(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Nodes that a window can use, and the largest score in each."""
            labels = self.label[nodes]
            nodes = nodes[(labels == label) | (labels == MIXED) if same else labels != label]
            lower, upper = self.bounds(nodes, anchor)
            useful = ((upper[:, None] >= least) & (lower[:, None] <= top)).any(1)
            return nodes[useful], upper[useful]

        def verify(leaves: np.ndarray) -> None:
            spans = [np.arange(a, b) for a, b in zip(self.low[leaves], self.high[leaves], strict=True)]
            points = np.concatenate(spans)
            points = points[((self.labels[points] == label) == same) & (self.ids[points] != own_id)]
            found = self.products(points, anchor)
            for i in range(len(windows)):
                inside = (found >= least[i]) & (found <= top[i])
                if not inside.any():
                    continue
                score = np.concatenate([scores[i], found[inside]])
                own = np.concatenate([ids[i], self.ids[points[inside]]])
                best = np.lexsort((own, -score))[:most]
                scores[i], ids[i] = score[best], own[best]
                if len(best) == most:
                    least[i] = max(least[i], score[best[-1]])

        ahead: list = []

        def push(nodes: np.ndarray) -> None:
            nodes, upper = wanted(nodes)
            leaf = self.last[nodes] == 0
            if leaf.any():
                heapq.heappush(ahead, (-upper[leaf].max(), 0, len(ahead), nodes[leaf]))
            for node, bound in zip(nodes[~leaf].tolist(), upper[~leaf].tolist(), strict=True):
                heapq.heappush(ahead, (-bound, 1, node, None))

        if len(self.low):
            push(np.zeros(1, np.int64))
        while ahead:
            bound, inner, node, leaves = heapq.heappop(ahead)
            if -bound < least.min():
                break  # no window can use what is left
            if inner:
                push(np.arange(self.first[node], self.last[node]))
            else:
                leaves, _ = wanted(leaves)
                if len(leaves):
                    verify(leaves)
        return [list(zip(s.tolist(), i.tolist(), strict=True)) for s, i in zip(scores, ids, strict=True)]


def _cone(radius: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and sine of the angle that a chord spans on a sphere; beyond a half circle, of that."""
    half = np.minimum(radius / (2 * norm), 1) if norm else np.zeros(len(radius))
    return 1 - 2 * half**2, 2 * half * np.sqrt(1 - half**2)


# -- Spark -------------------------------------------------------------------------------


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``vector`` (longs) and ``dim`` of the rows that take part."""
    ship_code(rows.sparkSession)
    vector = F.col("vector").cast("array<bigint>")
    fine = rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), vector.alias("vector")
    ).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    )
    one = fine.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("vec_id", "row.label", "row.vector", F.size("row.vector").alias("dim"))


INDEX = (
    "dim int, tree bigint, ids array<bigint>, labels array<int>, vectors array<bigint>, "
    + ", ".join(f"{name} array<{'double' if name == 'radius' else 'bigint'}>" for name in CoverTree.ARRAYS)
)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def build(found: pa.Table) -> pa.Table:
    found = found.sort_by("vec_id")
    dim, tree = found["dim"][0].as_py(), found["tree"][0].as_py()
    made = CoverTree.built(
        found["vec_id"].to_numpy(), found["label"].to_numpy().astype(np.int64), _matrix(found["vector"], dim)
    )
    arrays = {name: [getattr(made, name)] for name in CoverTree.ARRAYS}
    lists = pa.list_(pa.int64())
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "tree": pa.array([tree], pa.int64()),
        "ids": pa.array([made.ids], lists), "labels": pa.array([made.labels], pa.list_(pa.int32())),
        "vectors": pa.array([made.vectors.ravel()], lists),
        **{name: pa.array(values, pa.list_(pa.float64()) if name == "radius" else lists) for name, values in arrays.items()},
    })


def _stored(held: pa.Table, dim: int) -> CoverTree:
    array = lambda name: held[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ids = array("ids")
    nodes = {name: array(name) for name in CoverTree.ARRAYS}
    return CoverTree(ids, array("labels").astype(np.int64), array("vectors").reshape(len(ids), dim), nodes)


def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the ``tree`` of each, and the trees of each group of labels: ``first`` and ``parts``.

    Labels are dealt into as many groups as there are trees to fill; a group that is too large for one
    tree, as a frequent label makes it, is cut into parts by id.
    """
    need = lambda n: F.col(n) * F.greatest("dim", F.lit(1)) / TREE_VALUES
    by_dim = rows.groupBy("dim").agg(F.count("*").alias("n"))
    by_dim = lookup(staged(by_dim.select("dim", (1 + F.floor(need("n"))).alias("groups"))))
    grouped = rows.join(by_dim, "dim").withColumn("grp", F.pmod(F.xxhash64("label"), F.col("groups"))).drop("groups")
    sizes = grouped.groupBy("dim", "grp").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("parts", F.ceil(need("n")).cast("bigint"))
    before = Window.partitionBy("dim").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = staged(
        sizes.select("dim", "grp", "parts", F.coalesce(F.sum("parts").over(before), F.lit(0)).alias("first"))
    )
    placed = grouped.join(lookup(groups), ["dim", "grp"]).withColumn(
        "tree", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    )
    return placed, groups


FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"
FOUND_ARROW = pa.schema([(name, pa.int64()) for name in ("anchor_id", "positive_id", "positive_score", "vec_id", "score")])


def searched(asked: DataFrame, index: DataFrame, blocks: int, same: bool, most: int, window=WINDOW) -> DataFrame:
    """What the trees that are asked return, up to ``most`` rows per window and tree.

    ``asked`` has an anchor and a tree per row, and the anchor's positives if negatives are searched.
    """
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def find(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and held.num_rows:
            dim = held["dim"][0].as_py()
            tree, vectors = _stored(held, dim), _matrix(asked["vector"], dim)
            columns = [asked[c].to_pylist() for c in ("vec_id", "label", "positives")]
            for anchor, own_id, label, positives in zip(vectors, *columns, strict=True):
                if same:
                    found = tree.search(anchor, own_id, label, True, [LONG], most)
                    out += [(own_id, None, None, i, score) for score, i in found[0]]
                    continue
                low, high = window
                spans = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in positives]
                found = tree.search(anchor, own_id, label, False, spans, most)
                for p, rows in zip(positives, found, strict=True):
                    out += [(own_id, p["vec_id"], p["score"], i, score) for score, i in rows]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=FOUND_ARROW)

    keys = ("dim", "tree", "block")
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(find, FOUND)


def _best(found: DataFrame, most: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window=WINDOW
) -> DataFrame:
    """Per anchor and positive, the best rows of other labels whose score is in the positive's window.

    ``rows`` has ``vec_id``, ``label`` and ``vector`` (integers); ``anchors`` has the ``vec_id`` of rows
    that are anchors. An anchor's positives are the other rows of its label with the largest inner
    products. A negative's score is between 30 and 90 hundredths of the positive's, both included; where
    that is negative there is no such score. Ties go to smaller ids, equal vectors among them.
    Rows with a null id, label, vector or component take no part. Of rows with one id the one with the
    smallest label, then vector, takes part, so repeated rows count once. Vectors of other lengths have
    no score. Products beyond 64 bits count as the end of that range. Anchors without a positive, and
    empty tables, give no rows. Columns with other names are not looked at.
    """
    placed, groups = dealt(staged(usable(rows)))
    placed = staged(placed.select("vec_id", "label", "vector", "dim", "grp", "tree"))
    index = staged(placed.drop("grp").groupBy("dim", "tree").applyInArrow(build, INDEX))
    chosen = anchors.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct()
    asked = staged(placed.drop("tree").join(chosen, "vec_id", "left_semi"))
    blocks = 1 + asked.count() // BLOCK
    own = asked.join(lookup(groups), ["dim", "grp"]).select(
        "vec_id", "label", "vector", "dim", F.lit(None).cast("string").alias("positives"),
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("tree"),
    )
    nearest = _best(searched(own, index, blocks, True, positives), positives, "anchor_id")
    listed = staged(
        nearest.groupBy(F.col("anchor_id").alias("vec_id")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives")
        )
    )
    trees = lookup(staged(groups.groupBy("dim").agg(F.sum("parts").alias("trees"))))
    all_ = asked.join(listed, "vec_id").join(trees, "dim").select(
        "vec_id", "label", "vector", "dim", "positives",
        F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"),
    )
    found = searched(all_, index, blocks, False, negatives, window)
    return _best(found, negatives, "anchor_id", "positive_id").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


# -- the query ---------------------------------------------------------------------------


def scaled(vectors: DataFrame) -> DataFrame:
    """Vectors in whole 256ths, and every seventh label moved on by one.

    Null and non-finite components make a vector null; components beyond 64 bits are the end of the range.
    """
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    end = float(1 << 62)
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(256 * x, F.lit(end)), F.lit(-end))))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", moved.alias("label"), F.when(fine, whole).alias("vector"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(table(spark, sf_dir, "embeddings"))
    return hard_negatives(rows, rows.where(F.col("vec_id") % ANCHOR_EVERY == 0))


ORACLE = f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * cast(x as double)) for x in embedding] as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select a.vec_id as anchor_id, a.label = v.label as same, v.vec_id,
    cast(list_dot_product(a.v, v.v) as bigint) as score
  from v as a join v on a.vec_id <> v.vec_id and len(a.v) = len(v.v)
  where a.vec_id % {ANCHOR_EVERY} = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}),
n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score, cast(row_number() over (
    partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as integer) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same
    and 100 * s.score between {WINDOW[0]} * positive_score and {WINDOW[1]} * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score
from n where rank <= {NEGATIVES}"""
