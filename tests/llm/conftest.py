import pytest

# Columns of documents and more, some named like columns that operators make themselves.
DDL = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, digest string,"
    " fp long, shard int, part int, row string, score double, text_hash long, root long, words string, `a.b` string"
)
PASSAGE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, "one two three four five", "a"),
    (2, None, "a"),
    (3, "", "b"),
    (3, "", "b"),
    (4, " \t\n", None),
    (None, "one two three four five", "a"),
    (None, None, None),
    (5, "one  two\nthree four five ", "é"),
    (6, "x" * 30_000, "Z"),
    (7, "lorem ipsum " * 4_000, "a"),
    (8, f"start {PASSAGE} end", "b"),
    (9, f"other words before {PASSAGE}", "b"),
    (9, f"other words before {PASSAGE}", "b"),
    (10, f"{PASSAGE}", None),
    (11, f"{PASSAGE}", None),
    (12, "mail a.b@c.example.org or +1 (415) 555-0134, 4111 1111 1111 1111 and 10.0.0.1.", "a"),
    (13, "日本語 🙂 ▁ <|endoftext|> ÀÉ \x85", "a"),
    (14, "You STUPID st*pid 1d10t!!! You are a pathetic loser", "b"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (i, t, None, s, None, -1, "d", 7, 1, 2, "r", 0.5, 3, 4, "w", "x") for i, t, s in TEXTS
    ]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def odd_texts():
    return [(i, t) for i, t, _ in TEXTS]


@pytest.fixture(scope="session")
def some_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def some_texts(some_docs):
    return [tuple(r) for r in some_docs.select("doc_id", "text").collect()]


def listed(df, *columns):
    """Rows as tuples, in an order that does not depend on Spark."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
