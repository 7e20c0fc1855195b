import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import exact_dedup as ed
from cohortlens.llm.common import keep_one
from tests.llm import brute
from tests.llm.conftest import listed

COLUMNS = ("doc_id", "keep_id", "group_size", "text_sha256")


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(odd_docs, odd_texts, monkeypatch, small):
    if small:
        monkeypatch.setattr(ed, "BUCKET_DIGESTS", 3)
        monkeypatch.setattr(ed, "LOOKUP_ROWS", 2)
    found = ed.deduplicated(odd_docs)
    assert listed(found, *COLUMNS) == sorted(brute.exact_groups(odd_texts), key=str)
    kept = [r for r in found.collect() if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found.collect()})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_some_documents(some_docs, some_texts):
    found = ed.deduplicated(some_docs)
    assert listed(found, *COLUMNS) == sorted(brute.exact_groups(some_texts), key=str)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found.collect())


def test_no_rows(no_docs):
    assert ed.deduplicated(no_docs).count() == 0
    assert ed.deduplicated(no_docs, no_docs).count() == 0


def test_history(spark):
    ddl = "doc_id long, text string"
    history = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], ddl)
    new = spark.createDataFrame([(10, "ab"), (11, "d"), (12, "d "), (13, "c"), (14, "e")], ddl)
    found = {r.doc_id: r for r in ed.deduplicated(new, history).collect()}
    assert {i: (r.member, r.keep_id, r.kept) for i, r in found.items()} == {
        10: (True, 2, False),
        13: (True, 3, False),
        11: (False, 12, False),
        12: (False, 12, True),
        14: (False, 14, True),
    }
    empty = history.where(F.lit(False))
    assert {r.doc_id for r in ed.deduplicated(new, empty).where("kept").collect()} == {10, 12, 13, 14}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, (n, 4)).astype(np.uint64)
    levels, bits = ed.perfect_hash(keys)
    assert sorted(ed.slots_of(keys, levels, bits).tolist()) == list(range(n))
    others = rng.integers(0, 1 << 63, (100, 4)).astype(np.uint64)
    assert ed.slots_of(others, levels, bits).max(initial=-1) < max(n, 1)


def test_a_digest_of_others_is_no_member(spark):
    """A slot is found for many digests that were never put in; the bytes decide."""
    ddl = "doc_id long, text string"
    history = spark.createDataFrame([(i, f"old {i}") for i in range(50)], ddl)
    new = spark.createDataFrame([(i, f"new {i}") for i in range(500)], ddl)
    found = ed.deduplicated(new, history)
    assert found.where("member").count() == 0 and found.where("kept").count() == 500


@pytest.mark.parametrize("doc_id", ["CAST(NULL AS LONG)", "7L"])
def test_equal_rows_are_spread(spark, monkeypatch, doc_id):
    """A hot text whose ids are null or repeat: its rows do not meet, and one stays."""
    monkeypatch.setattr(ed, "LOOKUP_ROWS", 100)
    docs = spark.range(3000, numPartitions=3).selectExpr(f"{doc_id} AS doc_id", "'hot text' AS text")
    rows = ed.staged(ed.digested(docs))
    asked, _ = ed.dealt(rows, 1)
    parts = [r["count"] for r in asked.groupBy("bucket", "part").count().collect()]
    assert len(parts) == 30 and max(parts) < 200
    found = ed.deduplicated(docs)
    assert found.count() == 3000 and found.where("kept").count() == 1
    assert {(r.keep_id, r.group_size) for r in found.collect()} == {(None if "NULL" in doc_id else 7, 3000)}


def test_keep_one_lets_one_row_of_each_task_through(spark, tmp_path):
    docs = spark.range(3000, numPartitions=3).selectExpr("CAST(NULL AS LONG) AS doc_id", "'hot text' AS text")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = keep_one(docs, ed.deduplicated(docs).where("kept"))
    assert kept.collect() == [(None, "hot text")]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
