from collections import defaultdict

from cohortlens.llm import sharding
from tests.llm import brute
from tests.llm.conftest import listed


def placed(df):
    shards = defaultdict(list)
    sizes = defaultdict(int)
    for row in df.collect():
        shards[row.shard].append(row.slot)
        sizes[row.shard] += row.size
    return shards, sizes


def test_odd_rows(odd_docs, odd_texts):
    found = sharding.shard_documents(odd_docs)
    expected = [(i, len((t or "").encode()) + 1, brute.crc(t)) for i, t in odd_texts]
    assert listed(found, "doc_id", "size", "text_crc32") == sorted(expected, key=str)
    shards, _ = placed(found)
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())


def test_no_rows(no_docs):
    assert sharding.shard_documents(no_docs).count() == 0


def test_bytes_are_near_equal(some_docs):
    found = sharding.shard_documents(some_docs)
    _, sizes = placed(found)
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) < 1.01 * min(sizes.values())
    assert {r.law for r in found.collect()} == {"bytes"}
    again = sharding.shard_documents(some_docs.repartition(5))
    assert listed(again, *again.columns) == listed(found, *found.columns)


def test_many_equal_rows(spark, monkeypatch):
    """They are one row until they are written out, by runs."""
    monkeypatch.setattr(sharding, "RUN", 7)
    same = spark.range(500).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same' AS text")
    docs = same.unionAll(spark.range(300).selectExpr("id AS doc_id", "repeat('x', CAST(id % 9 AS INT)) AS text"))
    records = sharding.sized_records(docs)
    assert records.count() == 301 and records.agg({"n": "max"}).first()[0] == 500
    found = sharding.shard_documents(docs)
    shards, _ = placed(found)
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())
    assert sum(map(len, shards.values())) == 800
    assert found.where("doc_id IS NULL AND size = 5").count() == 500
    again = sharding.shard_documents(docs.repartition(3))
    assert listed(again, *again.columns) == listed(found, *found.columns)


def test_a_later_run_goes_on_from_the_stored_map(spark, some_docs, tmp_path):
    folder = str(tmp_path / "maps")
    first = sharding.shard_documents(some_docs, maps=folder).collect()
    again = sharding.shard_documents(some_docs, maps=folder).collect()
    grown = sharding.shard_documents(some_docs, shards=9, maps=folder).collect()
    assert [{r.map_version for r in rows} for rows in (first, again, grown)] == [{1}, {2}, {3}]
    assert sharding.latest_version(spark, folder) == 3
    assert sharding.load_map(spark, folder, 0).count() == sharding.SLOTS
    where = {r.doc_id: r.shard for r in again}
    moved = [r for r in grown if r.shard != where[r.doc_id]]
    total = sum(r.size for r in grown)
    assert 0.08 < sum(r.size for r in moved if r.shard == 8) / total < 0.14
    assert sum(r.size for r in moved if r.shard != 8) < 0.02 * total


def test_a_new_shard_only_takes(spark, some_docs, tmp_path):
    records = sharding.sized_records(some_docs)
    loads = sharding.slot_loads(records)
    old = sharding.rebalanced(sharding.first_map(spark), loads)
    new = sharding.rebalanced(old, loads, shards=9)
    folder = str(tmp_path / "maps")
    for slot_map in (old, new, new):
        sharding.store_map(slot_map, folder)
    before = {r.virtual_slot: r.shard for r in sharding.load_map(spark, folder, 1).collect()}
    after = {r.virtual_slot: r.shard for r in sharding.load_map(spark, folder, 2).collect()}
    assert len(before) == len(after) == sharding.SLOTS
    moved = {s for s in after if before[s] != after[s]}
    size = {r.virtual_slot: r.bytes for r in loads.collect()}
    total = sum(size.values())
    taken = sum(size[s] for s in moved if after[s] == 8)
    assert 0.1 < taken / total < 0.12
    # Hardly anything moves between the old shards.
    assert sum(size[s] for s in moved if after[s] != 8) < 0.01 * total


def test_a_lost_shard_gives_all_away(spark, some_docs):
    loads = sharding.slot_loads(sharding.sized_records(some_docs))
    fewer = sharding.rebalanced(sharding.first_map(spark), loads, shards=7)
    assert {r.shard for r in fewer.join(loads, "virtual_slot").where("bytes > 0").collect()} == set(range(7))
