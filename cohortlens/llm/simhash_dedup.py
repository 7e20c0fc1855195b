"""Near-duplicates by SimHash, linked by a self-join of binary tries.

Texts with one fingerprint form a class; only distinct fingerprints are joined. Two of them that
differ in at most 4 bits agree in 2 of 6 blocks, so each fingerprint is dealt out once for every
choice of 2 blocks, and those that agree there meet. Among these, a binary trie over the sorted
fingerprints is joined with itself: pairs of nodes go down together, differing bits add up, and a pair
whose sum exceeds the budget is left. A pair of nodes that is known to be connected throughout is left
too. What comes out is a spanning set of links, whose components are then found by Spark.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import by_text, documents, staged, table, text_hash
from cohortlens.llm.components import components

SHINGLE = 4
SEED = 42
BITS = 64
BUDGET = 4
# One block more than needed for a shared block, so that two are shared and the keys are long.
BLOCKS = 6
# Fingerprints of a key that are joined in one trie; more are cut into parts that are joined in pairs.
PART = 20_000
# Entries that are worked on in one group of keys, about.
GROUP = 200_000
# Pairs of trie nodes that go down together.
FRONT = 400_000
# Shingles that are hashed at a time.
CHUNK = 1 << 16


# -- fingerprints ------------------------------------------------------------------------


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the hashes of all shingles, repeats included; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[-n:] - 1
    digest, total = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        spans = zip(starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist(), strict=True)
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in spans])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp``, the fingerprint as a signed long."""

    def work(texts: list[str]) -> list:
        found = np.array([simhash(t) for t in texts], np.uint64)
        return [pa.array(found.view(np.int64))]

    rows = documents(docs).withColumn("text_hash", text_hash())
    return by_text(rows, work, "fp bigint", keep=("doc_id", "text_hash"))


# -- the trie join -----------------------------------------------------------------------


class Labels:
    """Which fingerprints are known to be connected: the smallest index of each one's component."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the components of ``a[i]`` and ``b[i]``, all pairs at once."""
        while True:
            low, high = self.root[a], self.root[b]
            low, high = np.minimum(low, high), np.maximum(low, high)
            open_ = low < high
            if not open_.any():
                break
            np.minimum.at(self.root, high[open_], low[open_])
            self._flatten()

    def _flatten(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up


def trie_join(
    fps: np.ndarray, spans: list[tuple[int, int, int, int]], budget: int = BUDGET
) -> np.ndarray:
    """Root index of each fingerprint, after linking those within ``budget`` bits in each span pair.

    ``fps`` (uint64) is sorted inside spans. A span pair (a, b, c, d) joins ``fps[a:b]`` with ``fps[c:d]``;
    a == c joins a span with itself. A trie node is a range of sorted fingerprints with a common
    prefix; the zeros and ones of the next bit split it.
    """
    labels = Labels(len(fps))
    if not len(fps):
        return labels.root
    # Neighbours in order are mostly near; linking them first lets whole subtries be left early.
    front = np.array(spans, np.int64).reshape(-1, 4)
    inside = np.zeros(len(fps), bool)
    for a, b, c, d in spans if len(spans) < 1000 else []:
        inside[a + 1 : b] = inside[c + 1 : d] = True
    near = np.flatnonzero(inside[1:] & (np.bitwise_count(fps[1:] ^ fps[:-1]) <= budget))
    labels.link(near, near + 1)
    waiting = [(0, front, np.zeros(len(front), np.int64))]
    while waiting:
        depth, front, error = waiting.pop()
        while len(front):
            if len(front) > FRONT:
                waiting.append((depth, front[FRONT:], error[FRONT:]))
                front, error = front[:FRONT], error[:FRONT]
            a, b, c, d = front.T
            single = (b - a == 1) & (d - c == 1)
            if single.any():
                x, y = a[single], c[single]
                near = np.bitwise_count(fps[x] ^ fps[y]) <= budget
                labels.link(x[near], y[near])
                front, error = front[~single], error[~single]
                if not len(front):
                    break
                a, b, c, d = front.T
            # Nodes whose fingerprints are all of one component have nothing to add.
            changes = np.concatenate([[0], np.cumsum(labels.root[1:] != labels.root[:-1])])
            known = (
                (changes[b - 1] == changes[a])
                & (changes[d - 1] == changes[c])
                & (labels.root[a] == labels.root[c])
            )
            if known.any():
                front, error = front[~known], error[~known]
                if not len(front):
                    break
                a, b, c, d = front.T
            ones = np.concatenate(
                [[0], np.cumsum((fps >> np.uint64(BITS - 1 - depth)) & np.uint64(1))]
            ).astype(np.int64)
            m, k = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
            same = a == c
            pairs = [
                (a, m, c, k, 0, None), (m, b, k, d, 0, None),
                (a, m, k, d, 1, None), (m, b, c, k, 1, ~same),
            ]
            fronts, errors = [], []
            for p, q, r, s, more, which in pairs:
                ok = (q > p) & (s > r) & (error + more <= budget)
                ok &= ~((q - p == 1) & (p == r) & (q == s))
                if which is not None:
                    ok &= which
                fronts.append(np.column_stack([p, q, r, s])[ok])
                errors.append(error[ok] + more)
            front, error = np.concatenate(fronts), np.concatenate(errors)
            depth += 1
    return labels.root


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def join_group(found: pa.Table) -> pa.Table:
    """Spanning links of all keys of a group; each run of equal keys is a trie, or a pair of tries."""
    columns = [found[n].to_numpy() for n in ("choice", "block_bits", "left", "right", "part", "fp")]
    choice, bits, left, right, part, fps = columns
    fps = fps.view(np.uint64)
    order = np.lexsort((fps, part, right, left, bits, choice))
    keys = np.column_stack([choice, bits, left, right, part])[order]
    fps = fps[order]
    n = len(fps)
    runs = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    ends = np.append(runs[1:], n)
    spans = []
    for i, (start, end) in enumerate(zip(runs.tolist(), ends.tolist(), strict=True)):
        lone = keys[start, 2] == keys[start, 3]
        if lone:
            if end - start > 1:
                spans.append((start, end, start, end))
        elif i and (keys[runs[i - 1], :4] == keys[start, :4]).all():
            spans.append((int(runs[i - 1]), start, start, end))
    root = trie_join(fps, spans)
    linked = np.flatnonzero(root != np.arange(n))
    # Copies of a fingerprint under other keys have indexes of their own.
    links = np.unique(
        np.column_stack([fps[linked].view(np.int64), fps[root[linked]].view(np.int64)]), axis=0
    )
    return pa.table([pa.array(links[:, 0]), pa.array(links[:, 1])], schema=LINK)


def choices(blocks: int = BLOCKS, shared: int = BLOCKS - BUDGET) -> list[int]:
    """Masks of all choices of ``shared`` blocks."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << (e - s)) - 1) << s for s, e in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, shared)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def links(distinct: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints ``fp`` within the budget.

    Keys that only one fingerprint has are dropped before any row goes to Python. A key with more than
    ``PART`` fingerprints is cut into parts by hash, and each pair of parts is joined by itself, so
    no task holds more than two parts of a key.
    """
    dealt = distinct.select(
        "fp",
        F.posexplode(
            F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in choices()))
        ).alias("choice", "block_bits"),
    )
    sizes = dealt.groupBy("choice", "block_bits").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / PART).cast("int")
    entries = dealt.join(sizes, ["choice", "block_bits"]).select(
        "choice", "block_bits", "fp", parts.alias("parts"),
        F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / PART)).cast("int").alias("part"),
    )
    paired = entries.select(
        "choice", "block_bits", "fp", "part",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"),
    ).select(
        "choice", "block_bits", "fp", "part",
        F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"),
    )
    paired = staged(paired)
    groups = 1 + paired.count() // GROUP
    key = F.xxhash64("choice", "block_bits", "left", "right")
    return (
        paired.withColumn("group", F.pmod(key, F.lit(groups)))
        .groupBy("group")
        .applyInArrow(join_group, "a bigint, b bigint")
    )


# -- components --------------------------------------------------------------------------


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprint of each row, and for each fingerprint the smallest id that its component reaches."""
    rows = staged(fingerprints(docs))
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = staged(components(links(distinct.select("fp"))))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = staged(rooted)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows, rooted.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, and the smallest id of its component.

    Texts without words (null ones too) have fingerprint zero and are linked like any other. Rows
    with a null id take part in links; they never name a component, unless all its ids are
    null (``component_id`` is null then). Repeated rows share a component. Columns other than id and
    text are not looked at. An empty table gives no rows.
    """
    rows, named = classes(docs)
    return rows.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "root",
        "text_hash",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text_hash`` of one row of each component: the smallest id, null ids last."""
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash")))
    chosen = near_duplicates(docs).groupBy("root").agg(first.alias("first"))
    return chosen.select("first.doc_id", "first.text_hash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")
