"""Exact dedup with a minimal perfect hash over the distinct digests of a history.

The history's distinct digests are dealt into buckets of bounded size. Each bucket gets a minimal
perfect hash: keys that are alone in a cell of a bit array are placed there, the others go on to the
next, smaller array, until all are placed; a key's slot is the number of set bits before its own.
A slot holds the full digest and the locator of the row that stays. Looked-up rows are members only
if the 32 bytes in their slot are theirs; members are repeats of the slot's row, the others are
grouped among themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import WHITE, by_text, documents, staged, table, text_hash
from cohortlens.session import lookup

# Distinct digests in a bucket, on average; a bucket of the index takes about 60 bytes for each.
BUCKET_DIGESTS = 40_000
# Looked-up rows that share a copy of a bucket; a bucket with more rows is copied.
LOOKUP_ROWS = 100_000
# Cells per key in each bit array.
CELLS = 1.6

INDEX = "bucket int, levels array<int>, bits binary, digests binary, keep_ids array<bigint>, keep_rows array<bigint>, sizes array<bigint>"


def digested(docs: DataFrame) -> DataFrame:
    """SHA-256 of each text without ASCII white space, and its length in code points; null is empty.

    ``row_id`` tells equal rows apart, and is fixed once the result is staged.
    """

    def work(texts: list[str]) -> list:
        plain = [t.encode().translate(None, WHITE) for t in texts]
        return [
            pa.array([hashlib.sha256(p).digest() for p in plain], pa.binary()),
            pa.array([len(t) for t in texts], pa.int32()),
        ]

    rows = documents(docs).select(
        "*", text_hash().alias("text_hash"), F.monotonically_increasing_id().alias("row_id")
    )
    return by_text(rows, work, "digest binary, chars int", keep=("doc_id", "text_hash", "row_id"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: the row that stays (most code points, then smallest id, null ids last).

    Rows that are equal in both are told apart by a hash of the text, then by ``row_id``.
    """
    first = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), "doc_id", "text_hash", "row_id"))
    return rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size")).select(
        "digest",
        F.col("first.doc_id").alias("keep_id"),
        F.col("first.row_id").alias("keep_row"),
        "group_size",
    )


# -- the hash ----------------------------------------------------------------------------


def _cells(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
    """Cell of each digest, given as rows of four uint64, in the bit array of ``level``."""
    step = 0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)
    mixed = keys[:, level % 4] + np.uint64(step)
    mixed ^= keys[:, (level + 1) % 4] >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return (mixed % np.uint64(cells)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the bit arrays, and all their bits in a row, for distinct ``keys``."""
    levels, bits, left = [], [], keys
    while len(left):
        cells = max(8, int(len(left) * CELLS))
        at = _cells(left, len(levels), cells)
        alone = np.bincount(at, minlength=cells) == 1
        levels.append(cells)
        bits.append(alone)
        left = left[~alone[at]]
    return levels, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots_of(keys: np.ndarray, levels: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no array has it. Keys outside the set may get anyone's slot."""
    before = np.concatenate([[0], np.cumsum(bits)])
    slots, left, offset = np.full(len(keys), -1), np.arange(len(keys)), 0
    for level, cells in enumerate(levels):
        if not len(left):
            break
        at = offset + _cells(keys[left], level, cells)
        hit = bits[at]
        slots[left[hit]] = before[at[hit]]
        left, offset = left[~hit], offset + cells
    return slots


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


# -- index and lookup --------------------------------------------------------------------


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def build_index(distinct: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: its hash, and per slot the digest, the row that stays, its group's size."""

    def build(found: pa.Table) -> pa.Table:
        digests = found["digest"].to_pylist()
        keys = _keys(digests)
        levels, bits = perfect_hash(keys)
        order = np.argsort(slots_of(keys, levels, bits))
        in_slots = found.take(pa.array(order))
        row = {
            "bucket": [found["bucket"][0].as_py()],
            "levels": [levels],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [b"".join(in_slots["digest"].to_pylist())],
            "keep_ids": [in_slots["keep_id"].to_pylist()],
            "keep_rows": [in_slots["keep_row"].to_pylist()],
            "sizes": [in_slots["group_size"].to_pylist()],
        }
        return pa.table(row, schema=_arrow(INDEX))

    return distinct.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInArrow(build, INDEX)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {
        "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(),
        "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
    }
    return pa.schema([(n, kinds[t]) for n, t in (part.split() for part in ddl.split(", "))])


FOUND = (
    "doc_id bigint, text_hash bigint, row_id bigint, digest binary, chars int, member boolean, keep_id bigint,"
    " group_size bigint, kept boolean"
)


def dealt(rows: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their bucket and the copy of it that they are looked up in, and the number of copies
    of each crowded bucket.

    Rows of a crowded bucket are spread one by one, so equal rows, however many, do not meet in one
    task, whether their ids differ, repeat or are null.
    """
    spread = F.ceil(F.count("*") / LOOKUP_ROWS).cast("int")
    placed = rows.withColumn("bucket", bucket_of(buckets))
    crowded = placed.groupBy("bucket").agg(spread.alias("spread")).where("spread > 1")
    crowded = lookup(staged(crowded))
    part = F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("spread")), F.lit(0)).cast("int")
    return placed.join(crowded, "bucket", "left").withColumn("part", part).drop("spread"), crowded


def look_up(rows: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Rows with ``member``, and for members the row that stays, the group's size and ``kept``."""
    asked, crowded = dealt(rows, buckets)
    held = index.join(crowded, "bucket", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)) - 1))
    ).drop("spread")

    def find(asked: pa.Table, held: pa.Table) -> pa.Table:
        digests, row_ids = asked["digest"].to_pylist(), asked["row_id"].to_pylist()
        slots = np.full(len(digests), -1)
        if held.num_rows and digests:
            entry = held.to_pylist()[0]
            bits = np.unpackbits(
                np.frombuffer(entry["bits"], np.uint8), count=sum(entry["levels"])
            ).astype(bool)
            slots = slots_of(_keys(digests), entry["levels"], bits)
        out = {n: [] for n in ("member", "keep_id", "group_size", "kept")}
        for digest, row_id, slot in zip(digests, row_ids, slots.tolist(), strict=True):
            member = slot >= 0 and entry["digests"][32 * slot : 32 * slot + 32] == digest
            out["member"].append(member)
            out["keep_id"].append(entry["keep_ids"][slot] if member else None)
            out["group_size"].append(entry["sizes"][slot] if member else None)
            out["kept"].append(member and row_id == entry["keep_rows"][slot])
        schema = _arrow(FOUND)
        same = {n: asked[n].cast(schema.field(n).type) for n in schema.names if n not in out}
        return pa.table(same | out, schema=schema)

    return asked.groupBy("bucket", "part").cogroup(held.groupBy("bucket", "part")).applyInArrow(find, FOUND)


def deduplicated(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per document: the row that stays for its text, and whether it is that row.

    Without a history the documents are their own: all are members, and of equal texts the row with
    the most code points, then the smallest id, stays. With a history (``doc_id``, ``text``), members
    are repeats of a row that was published before: ``keep_id`` is the historical row and none of
    them is kept; the others are grouped among themselves as above. Null texts are empty texts;
    empty texts form one group; rows with a null id stay only if all ids of the group are null,
    and of rows that are equal in id and length one is kept. Columns other than id and text are
    not looked at. Empty tables give no rows.
    """
    rows = staged(digested(docs))
    if history is None:
        found = _within(rows)
    else:
        past = staged(distinct_digests(digested(history)))
        buckets = _buckets(past)
        looked = staged(look_up(rows, staged(build_index(past, buckets)), buckets))
        # Members repeat what is published; "kept" there means the historical row itself.
        members = looked.where("member").withColumn("kept", F.lit(False))
        new = looked.where("NOT member").select("doc_id", "text_hash", "row_id", "digest", "chars")
        found = members.unionByName(_within(staged(new)).withColumn("member", F.lit(False)))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
        "member",
        "text_hash",
    )


def _buckets(distinct: DataFrame) -> int:
    return 1 + distinct.count() // BUCKET_DIGESTS


def _within(rows: DataFrame) -> DataFrame:
    distinct = staged(distinct_digests(rows))
    buckets = _buckets(distinct)
    return look_up(rows, staged(build_index(distinct, buckets)), buckets)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
g as (
  select *, count(*) over (partition by text_sha256) as group_size,
    first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id) as keep_id
  from d)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, text_sha256
from g"""
