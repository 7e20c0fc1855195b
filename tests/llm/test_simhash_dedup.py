import numpy as np
import pytest

from cohortlens.llm import simhash_dedup as sd
from cohortlens.llm.components import components
from tests.llm import brute
from tests.llm.conftest import listed

COLUMNS = ("doc_id", "fingerprint", "component_id")


def test_odd_rows(odd_docs, odd_texts):
    found = sd.near_duplicates(odd_docs)
    assert listed(found, *COLUMNS) == sorted(brute.near_groups(odd_texts), key=str)


def test_some_documents(some_docs, some_texts):
    found = sd.near_duplicates(some_docs)
    assert listed(found, *COLUMNS) == sorted(brute.near_groups(some_texts), key=str)
    chosen = sd.one_of_each(some_docs)
    assert {r.doc_id for r in chosen.collect()} == {r.component_id for r in found.collect()}


def test_no_rows(no_docs):
    assert sd.near_duplicates(no_docs).count() == 0


def test_only_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.component_id for r in sd.near_duplicates(docs).collect()] == [None, None]


def clusters(rng, n, centres, flips):
    """Fingerprints around a few centres, some linked in chains only."""
    middle = rng.integers(0, 1 << 63, centres).astype(np.uint64)
    fps = middle[rng.integers(0, centres, n)]
    for _ in range(flips):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(np.concatenate([fps, rng.integers(0, 1 << 63, n // 4).astype(np.uint64)]))


def by_root(fps, root):
    groups = {}
    for fp, r in zip(fps.tolist(), root, strict=True):
        groups.setdefault(r, set()).add(fp)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("flips", [1, 3, 6])
@pytest.mark.parametrize("front", [50, 400_000])
def test_trie_join_finds_all_links(monkeypatch, flips, front):
    monkeypatch.setattr(sd, "FRONT", front)
    fps = clusters(np.random.default_rng(flips), 700, 5, flips)
    root = sd.trie_join(fps, [(0, len(fps), 0, len(fps))])
    docs = [(i, None) for i in range(len(fps))]
    expected = [r[2] for r in brute.near_groups(docs, fps.tolist())]
    assert by_root(fps, root.tolist()) == by_root(fps, expected)


@pytest.mark.parametrize("part", [20_000, 40])
def test_keys_and_parts_lose_no_link(spark, monkeypatch, part):
    monkeypatch.setattr(sd, "PART", part)
    monkeypatch.setattr(sd, "GROUP", 300)
    fps = clusters(np.random.default_rng(9), 300, 3, 4)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components(sd.links(df)).collect()}
    found = [roots.get(int(f), int(f)) for f in fps.view(np.int64)]
    docs = [(i, None) for i in range(len(fps))]
    expected = [r[2] for r in brute.near_groups(docs, fps.tolist())]
    assert by_root(fps, found) == by_root(fps, expected)


def test_any_four_bits_leave_two_blocks():
    masks = sd.choices()
    rng = np.random.default_rng(3)
    for _ in range(500):
        flipped = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flipped & mask == 0 for mask in masks)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    links = spark.createDataFrame(chain + chain[:5], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    assert components(links.where("a < 0")).count() == 0


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = sd.simhash(text)
    monkeypatch.setattr(sd, "CHUNK", 64)
    assert sd.simhash(text) == whole == brute.fingerprint(text)
