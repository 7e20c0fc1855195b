import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import hard_negatives as hn
from tests.llm.conftest import listed

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
DDL = "vec_id long, embedding array<double>, label int, vector string, tree string, grp int, score int"


def oracle(rows):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INT)")
    if rows:
        connection.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    return sorted(connection.execute(hn.ORACLE).fetchall(), key=str)


@pytest.fixture
def answer(spark, tmp_path):
    def run(rows):
        more = [(*r, "v", "t", 1, 2) for r in rows]
        spark.createDataFrame(more, DDL).write.parquet(f"{tmp_path}/embeddings.parquet")
        return listed(hn.query(spark, str(tmp_path)), *COLUMNS)

    return run


def drawn(n, dim=6, labels=4, seed=1, spread=0.4):
    """Vectors around a few centres, some of them equal."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (8, dim))
    vectors = centres[rng.integers(0, 8, n)] + rng.normal(0, spread, (n, dim))
    vectors[::9] = vectors[0]
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(vectors, rng.integers(0, labels, n), strict=True))]


def test_given_table(spark, sf_dir):
    found = hn.query(spark, sf_dir)
    assert dict(found.dtypes) == {c: "int" if c == "rank" else "bigint" for c in COLUMNS}
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    expected = connection.execute(hn.ORACLE).fetchall()
    assert expected and listed(found, *COLUMNS) == sorted(expected, key=str)


def test_many_trees_and_blocks(monkeypatch, answer):
    monkeypatch.setattr(hn, "TREE_VALUES", 600)
    monkeypatch.setattr(hn, "BLOCK", 3)
    rows = drawn(1500)
    assert answer(rows) == oracle(rows)


def test_one_label_has_most_rows(monkeypatch, answer):
    monkeypatch.setattr(hn, "TREE_VALUES", 600)
    rows = [(i, v, k if i % 3 else 1) for i, v, k in drawn(1200, labels=9, seed=2)]
    assert answer(rows) == oracle(rows)


def test_odd_rows(answer):
    nan, inf = float("nan"), float("inf")
    fine = [*drawn(220, dim=2, labels=2), (300, [1.0], 1), (301, [2.0], 1), (302, [0.9], 0), (400, [], 0), (402, [], 0), (404, [], 1)]
    odd = [
        (500, None, 1), (501, [1.0, None], 1), (502, [nan, 1.0], 1), (503, [inf, 1.0], 0), (504, [1.0, 1.0], None),
        (None, [1.0, 1.0], 1),
    ]
    # Repeated rows count once; of one id's rows the one with the smallest label takes part.
    again = [(100, fine[100][1], fine[100][2]), (3, [9.0, 9.0], 7)]
    assert answer(fine + odd + again) == oracle(fine)


def test_no_rows(answer):
    assert answer([]) == []


def test_no_positives_or_negatives(answer):
    assert answer([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 3)]) == []


def test_large_components_are_exact(answer):
    rows = [(100, [2.0**16, 1.0], 1), (1, [2.0**15, 3.0], 1), (2, [2.0**14 + 1 / 256, 5.0], 2), (3, [2.0**14, 5.0], 2)]
    found = answer(rows)
    assert [r[3] for r in sorted(found, key=lambda r: r[2])] == [2, 3]
    assert found == oracle(rows)


def test_products_beyond_64_bits(answer):
    rows = [(100, [1e30], 1), (1, [1e30], 1), (2, [1e25], 2)]
    assert answer(rows) == []  # both scores are at the end of the range, so none is in the window


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 200), st.integers(1, 8))
def test_tree_search_is_exact(seed, n, dim):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-40, 40, (n, dim)) * rng.choice([1, 30], (n, 1))
    labels, ids = rng.integers(0, 3, n), rng.permutation(n)
    tree = hn.CoverTree.built(ids, labels, vectors)
    points = [np.arange(a, b) for a, b, last in zip(tree.low, tree.high, tree.last, strict=True) if not last]
    assert sorted(np.concatenate(points)) == list(range(n))  # every row is in one leaf
    anchor = rng.integers(-40, 40, dim)
    windows = [(-200, 100), (50, 3000), hn.LONG]
    score = vectors @ anchor
    for same in (True, False):
        found = tree.search(anchor, 0, 1, same, windows, 4)
        for (low, high), rows in zip(windows, found, strict=True):
            fits = ((labels == 1) == same) & (ids != 0) & (score >= low) & (score <= high)
            expected = sorted((-int(s), int(i)) for s, i in zip(score[fits], ids[fits], strict=True))[:4]
            assert rows == [(-s, i) for s, i in expected]


def test_outside_nodes_are_skipped():
    """Of a table with clusters, a search looks at a small part."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (60, 16))
    vectors = np.repeat(centres, 60, 0) + rng.integers(-9, 9, (3600, 16))
    tree = hn.CoverTree.built(np.arange(3600), np.arange(3600) % 5, vectors)
    seen, plain = [], tree.products
    tree.products = lambda points, anchor: seen.append(np.size(points)) or plain(points, anchor)
    tree.search(vectors[0], 0, 0, True, [hn.LONG], 5)
    assert sum(seen) < 900
