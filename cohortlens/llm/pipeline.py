"""The stages of the training corpus: clean, distinct, mixed and encoded documents.

Each stage gets what the one before it kept, written as Parquet and read back, and applies one operator.
Empty tables give empty tables. Columns of any name stay as they are: operators see only id, text and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import exact_dedup, mixing, sentencepieces, simhash_dedup, toxicity
from cohortlens.llm.common import keep_one, release, staged, table, whole_row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under the threshold, all columns as they were.

    The model is fitted on the labels of ``sf_dir`` and the texts of ``docs``. Rows are scored one by
    one, rows with null ids and repeated rows too, null texts as empty ones. Without labels all rows stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(whole_row(docs), F.col("text").cast("string").alias("text"))
    scored = toxicity.scored(rows, model, keep=("row",))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: most code points, then smallest id, null ids last.

    Of rows that are equal in id and text, one stays.
    """
    return keep_one(docs, exact_dedup.deduplicated(docs).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, null ids last.

    Near copies are what the trie join links: four-word fingerprints that differ in 4 bits at most.
    Of rows that are equal in id and text, one stays. Texts without words are one group.
    """
    return keep_one(docs, simhash_dedup.one_of_each(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, which may be never.

    Rows without words come as often as their source is taken whole, and never more than a target allows.
    Rows with null ids take part like any other.
    """
    return keep_one(docs, mixing.repetitions(docs), repeats=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's text, repeated rows and rows with null ids each by themselves."""
    return sentencepieces.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("SentencePiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what one stage wrote goes when the next has been written."""
    docs, old = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        release(*old)
        old = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
