import random

import numpy as np
import pytest

from cohortlens.llm import substring_dedup as sd
from tests.llm import brute
from tests.llm.conftest import listed

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_odd_rows(odd_docs, odd_texts):
    found = sd.without_repeats(odd_docs)
    assert listed(found, *COLUMNS) == sorted(brute.without_repeats(odd_texts), key=str)


def test_some_documents(some_docs, some_texts):
    found = sd.without_repeats(some_docs)
    assert listed(found, *COLUMNS) == sorted(brute.without_repeats(some_texts), key=str)


def test_no_rows(no_docs):
    assert sd.without_repeats(no_docs).count() == 0


def patchwork(seed):
    """Texts made of passages that start, end and overlap anywhere, over few words."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(30)]
    sources = [[rng.choice(pool) for _ in range(200)] for _ in range(4)]
    docs = []
    for doc_id in rng.sample(range(1000), 40):
        words = []
        for _ in range(rng.randrange(4)):
            source = rng.choice(sources)
            start = rng.randrange(len(source))
            words += source[start : start + rng.choice([20, 49, 50, 51, 70, 120])]
            words += [rng.choice(pool) for _ in range(rng.randrange(5))]
        docs.append((doc_id, rng.choice([" ", "\n", "  "]).join(words)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_that_overlap(spark, monkeypatch, seed):
    monkeypatch.setattr(sd, "SHARD_WINDOWS", 100)
    monkeypatch.setattr(sd, "SHARD_BYTES", 500)
    docs = patchwork(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = sd.without_repeats(frame)
    expected = brute.without_repeats(docs)
    assert sum(r[2] for r in expected) > 500
    assert listed(found, *COLUMNS) == sorted(expected, key=str)


def test_one_id_with_two_texts(spark):
    """Rows that share an id take nothing from each other."""
    passage = " ".join(f"p{i}" for i in range(55))
    docs = [(1, f"a {passage}"), (1, f"b {passage}"), (2, f"c {passage}"), (None, passage)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = sd.without_repeats(frame)
    assert listed(found, *COLUMNS) == sorted(brute.without_repeats(docs), key=str)
    texts = {r.kept_text for r in found.where("doc_id = 2").collect()}
    assert texts == {"c"}


def test_repeats_within_a_document_stay(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    frame = spark.createDataFrame([(1, f"{passage} {passage}")], "doc_id long, text string")
    assert sd.without_repeats(frame).first().n_removed == 0


def test_hashes_do_not_depend_on_the_place():
    tail = " ".join(f"t{i}" for i in range(80))
    a, b = sd.Words(f"x yy {tail}"), sd.Words(f"{'long ' * 900}{tail}")
    assert (a.windows()[0][2:] == b.windows()[0][900:]).all()
    assert (a.windows()[1][2:] == b.windows()[1][900:]).all()
    assert (a.anchors()[2:] == b.anchors()[900:]).all()


def test_words_that_defeat_sums_of_letters(spark):
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2^64, whatever the base."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    common = " ".join(f"w{i}" for i in range(49))
    docs = [(1, f"{common} {word}"), (2, f"{common} {word.translate(str.maketrans('ab', 'ba'))}"), (3, f"{common} {word}")]
    found = sd.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in found.collect()} == {1: 0, 2: 0, 3: 50}


def test_sequences_that_defeat_sums_of_words():
    """The same with words for letters: windows that differ have different hashes."""
    letters = ["yes", "no"]
    one = [letters[i.bit_count() % 2] for i in range(4096)]
    two = [letters[1 - i.bit_count() % 2] for i in range(4096)]
    distinct = {tuple(w[i : i + 50]) for w in (one, two) for i in range(len(w) - 49)}
    hashes = [sd.Words(" ".join(w)).windows() for w in (one, two)]
    for k in range(2):
        assert len(set(np.concatenate([h[k] for h in hashes]).tolist())) == len(distinct)
