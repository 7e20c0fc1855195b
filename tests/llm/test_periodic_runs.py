import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import periodic_runs as pr
from tests.llm import brute
from tests.llm.conftest import listed

COLUMNS = (
    "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
)


def expected(texts):
    return sorted((brute.runs_digest(i, t) for i, t in texts), key=str)


@pytest.fixture
def as_table(tmp_path):
    def write(df):
        df.write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def test_some_documents(spark, sf_dir, some_texts):
    found = pr.query(spark, sf_dir)
    assert found.columns == list(COLUMNS)
    assert [t for _, t in found.dtypes][1:6] == ["bigint"] * 5
    assert listed(found, *COLUMNS) == expected(some_texts)
    assert found.where("n_runs > 0").count() > 5


def test_odd_rows(spark, odd_docs, odd_texts, as_table):
    assert listed(pr.query(spark, as_table(odd_docs)), *COLUMNS) == expected(odd_texts)


def test_no_rows(spark, no_docs, as_table):
    assert pr.query(spark, as_table(no_docs)).count() == 0


def test_many_planted_documents(spark, as_table):
    """Ids whose checksum asks for repetitions, over few and over many different words."""
    rng = random.Random(3)
    ids = [i for i in range(2000) if brute.crc(str(i)) % 10 == 0]
    texts = [(i, " ".join(f"w{rng.randrange(2 + i % 40)}" for _ in range(rng.randrange(90)))) for i in ids]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert listed(pr.query(spark, as_table(frame)), *COLUMNS) == expected(texts)


def test_runs_and_text_of_the_operator(spark):
    frame = spark.createDataFrame([(1, "x a b a b\na b  a b y z z z z z z")], "doc_id long, text string")
    row = pr.periodic_runs(frame).first()
    assert [tuple(r) for r in row.runs] == [(1, 8, 2), (10, 6, 1)]
    assert row.collapsed == "x a b y z"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=7), st.integers(1, 9)), max_size=8))
def test_runs_of_repeated_pieces(pieces):
    words = list("".join(piece * times for piece, times in pieces))
    assert pr.runs_of(words) == brute.runs(words)


def test_runs_that_follow_and_overlap():
    rng = random.Random(5)
    for _ in range(300):
        words = []
        while len(words) < 150:
            unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
            words += (unit * 8)[: rng.randrange(1, 80)]
        assert pr.runs_of(words) == brute.runs(words)


def test_runs_are_known_while_words_come():
    words, runs = list("xyababababababcccccccc"), pr.Runs()
    for i, word in enumerate(words):
        runs.append(word)
        assert runs.all() == brute.runs(words[: i + 1])


def test_long_run_of_long_period():
    words = [f"w{i}" for i in range(3000)] * 5 + ["end"] + ["w"] * 20_000
    assert pr.runs_of(words) == [(0, 15_000, 3000), (15_001, 20_000, 1)]
