import duckdb
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import mixing
from tests.llm.conftest import TEXTS, listed

COLUMNS = ("doc_id", "size", "source_size", "target", "taken")


def oracle(rows):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        connection.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(connection.execute(mixing.ORACLE).fetchall(), key=str)


def test_odd_rows(odd_docs):
    assert listed(mixing.mixed(odd_docs), *COLUMNS) == oracle(TEXTS)


def test_no_rows(no_docs):
    assert mixing.mixed(no_docs).count() == 0


def test_sources_come_near_their_targets(some_docs, some_texts):
    found = mixing.mixed(some_docs).join(some_docs.select("doc_id", "source"), "doc_id")
    by_source = found.groupBy("source").agg(
        F.first("target").alias("target"), F.sum("taken").alias("taken"),
        F.first("source_size").alias("size"), F.max("size").alias("largest"),
    ).collect()
    assert sum(r.target for r in by_source) == pytest.approx(sum(r["size"] for r in by_source))
    assert all(r.target <= 3 * r["size"] for r in by_source)
    assert all(abs(r.taken - r.target) <= r.largest / 2 for r in by_source)
    assert found.where("taken > 3 * size").count() == 0
    again = mixing.mixed(some_docs.repartition(7))
    assert listed(again, *COLUMNS) == listed(mixing.mixed(some_docs), *COLUMNS)


def test_excess_is_shared_again(spark):
    """Capped one after the other: 5 of 8 of the words for a source that has few."""
    rows = [(1, "w " * 10, "a"), (2, "w " * 20, "b"), (3, "w " * 970, "c")]
    found = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.doc_id: r.target for r in found.collect()} == {1: 30.0, 2: 60.0, 3: 910.0}
    assert [r.taken for r in found.orderBy("doc_id").collect()] == [30, 60, 970]


def test_an_empty_source_gets_nothing(spark):
    rows = [(1, "", "a"), (2, "w w w", "b"), (3, None, None)]
    found = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.doc_id: (r.target, r.taken) for r in found.collect()} == {
        1: (0.0, 0), 2: (3.0, 3), 3: (0.0, 0)
    }


@pytest.mark.parametrize("size", [1, 3])
def test_one_of_many_equal_rows_is_switched(spark, size):
    """Equal rows are one entry, but each is taken or left by itself."""
    rows = [(5, "w " * size, "a")] * 200 + [(i, "w " * 101, "a") for i in range(10, 20)]
    rows += [(i, "w " * 97, "b") for i in range(30, 39)] + [(None, "x y", "c")] * 300
    found = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    taken = listed(found, *COLUMNS)
    assert taken == oracle(rows)
    by_source = found.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert all(abs(r.taken - r.target) <= 50.5 for r in by_source.collect())


def test_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPREAD", 3)
    rows = [(1, "w w", "a")] * 50 + [(2, "w w w", "b")] * 31 + [(3, "", "a")] * 4
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert listed(mixing.mixed(frame), *COLUMNS) == oracle(rows)
    repeats = {r.doc_id: r.repeats for r in mixing.repetitions(frame).collect()}
    again = mixing.mixed(frame).groupBy("doc_id").agg(F.sum("repeats").alias("n"))
    assert repeats == {r.doc_id: r.n for r in again.collect()}


def test_main_path_is_native(some_docs):
    text = mixing.mixed(some_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
