import numpy as np
import pytest

from cohortlens.llm import nearest
from tests.llm import brute

DDL = "vec_id long, embedding array<float>, label int, node long, vector string, shard int, dim int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "v", 2, 3) for i, v in rows], DDL)


def found(spark, rows, queries, k=10):
    df = frame(spark, rows)
    out = nearest.nearest(df, df.where(df.vec_id.isin(queries)), k)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect())


def exact(rows, queries, k=10):
    usable = {i: v for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    return sorted(brute.nearest(usable, [q for q in queries if q in usable], k))


def test_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(150)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 4), (2003, [1.0, None, 0.0, 0.0])]
    rows += [(2004, [float("nan"), 1.0, 0.0, 0.0]), (2005, [float("inf"), 1.0, 0.0, 0.0])]
    queries = [0, 100, 200, 1000, 1100, 2000, 2002, 2003, 2004]
    got, want = found(spark, rows, queries), exact(rows, queries)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want])


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (None, [3.0, 3.0])]
    assert [x[:3] for x in found(spark, rows, [0])] == [(0, 1, 2), (0, 2, 1)]
    assert found(spark, [(0, [1.0])], [0]) == []


def test_other_lengths_are_no_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [5.0, 0.0])]
    assert [x[:3] for x in found(spark, rows, [0])] == [(0, 1, 2)]


def test_no_vectors(spark):
    assert found(spark, [], [0]) == []


def test_recall_over_shards(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_ROWS", 120)
    monkeypatch.setattr(nearest, "BLOCK", 2)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r.vec_id: list(r.embedding) for r in vectors.collect()}
    queries = [i for i in sorted(rows) if i % 20 == 0]
    out = nearest.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect()
    got = {(r.query_id, r.vec_id): r.score for r in out}
    want = {(q, i): s for q, _, i, s in brute.nearest(rows, queries)}
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.95 * len(want)
    assert all(got[x] == pytest.approx(want[x], rel=1e-12) for x in set(got) & set(want))


def test_stored_graph_is_the_built_one():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    levels = nearest.drawn_levels(np.arange(400))
    assert levels.max() > 0
    built = nearest.Graph.built(vectors, levels)
    flat = [built.flat(i) for i in range(400)]
    again = nearest.Graph.stored(vectors, levels, flat)
    assert all((a == b).all() for a, b in zip(built.near, again.near, strict=True))
    assert built.search(vectors[3], 20)[0] == 3 == again.search(vectors[3], 20)[0]


def test_recall_of_a_whole_shard():
    """Production parameters: one graph of SHARD_ROWS vectors, a part of them in tight clusters."""
    rng = np.random.default_rng(4)
    n, dim = nearest.SHARD_ROWS, 64
    centres = rng.normal(0, 1, (80, dim))
    tight = centres[rng.integers(0, 80, n // 2)] + rng.normal(0, 0.05, (n // 2, dim))
    vectors = np.concatenate([rng.normal(0, 1, (n - n // 2, dim)), tight]).astype(np.float32)
    graph = nearest.Graph.built(vectors, nearest.drawn_levels(np.arange(n)))
    found = 0
    queries = range(0, n, 64)
    for i in queries:
        exact = np.argsort(((vectors - vectors[i]) ** 2).sum(1), kind="stable")[: nearest.K + 1]
        found += len(set(exact.tolist()) & set(graph.search(vectors[i], nearest.SEARCH_VIEW)[: nearest.K + 1]))
    recall = found / (len(queries) * (nearest.K + 1))
    print("recall", recall)
    assert recall >= 0.95


def test_repeated_query_ids(spark):
    """Of rows with one id, the smallest vector is the query; all are candidates of others."""
    rows = [(0, [5.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [5.0, 1.0]), (2, [5.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = nearest.nearest(frame, frame.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found][:1] == [(1, 1.0)]
    assert {r.vec_id for r in found} == {1, 2}
