import zlib

import numpy as np
import pytest

from cohortlens.llm import toxicity as tx


@pytest.fixture(scope="module")
def scored(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs, labels, tx.toxicity(docs, labels).collect()


def area(scores, labels):
    scores, labels = np.array(scores), np.array(labels)
    pairs = scores[labels == 1][:, None] - scores[labels == 0][None]
    return (pairs > 0).mean() + (pairs == 0).mean() / 2


def test_held_out_rows_are_ranked(scored):
    _, labels, found = scored
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in toxic]
    # Toxic texts in other languages than English have no words in common in so small a table.
    assert area([r.score for r in held], [toxic[r.doc_id] for r in held]) > 0.8
    clean = [r for r in found if toxic.get(r.doc_id) == 0]
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_held_out_labels_are_never_seen(scored):
    docs, labels, found = scored
    turned = labels.selectExpr(
        "doc_id", "quality",
        "IF(crc32(CAST(doc_id AS STRING)) % 3 = 1, 1 - toxic, toxic) AS toxic",
    )
    again = tx.toxicity(docs, turned).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_odd_rows(spark, odd_docs, odd_texts):
    labels = spark.createDataFrame(
        [(1, 0), (14, 1), (14, 1), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int"
    )
    found = tx.toxicity(odd_docs, labels)
    assert sorted(str(r.doc_id) for r in found.collect()) == sorted(str(i) for i, _ in odd_texts)
    empty = {r.score for r in found.where("doc_id IN (2, 3)").collect()}
    assert len(empty) == 1


def test_no_rows_and_no_labels(spark, no_docs, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.toxicity(no_docs, labels).count() == 0
    assert {r.score for r in tx.toxicity(odd_docs, labels).collect()} == {0.0}


def test_rows_are_bounded_and_a_text_counts_once(spark):
    """Ids that repeat, with one text or many, and texts that repeat: the bound is on texts."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    hot, rest = ids[0], ids[1:]
    rows = [(hot, f"text {k}") for k in range(300)] + [(hot, "same")] * 300
    rows += [(i, "same" if i % 2 else f"own {i}") for i in rest]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == rest[1])) for i in ids for _ in (0, 1)], "doc_id long, toxic int")
    found = tx.training_sample(docs, labels).collect()
    assert sorted(r.text for r in found) == sorted({t for _, t in rows})
    toxic = dict(rows)[rest[1]]
    assert {r.text for r in found if r.toxic} == {toxic}
    few = tx.training_sample(docs, labels, rows=50)
    assert few.count() == 51 and few.where("toxic = 1").count() == 1 or few.count() == 50
    again = tx.training_sample(docs.repartition(5), labels, rows=50)
    assert sorted(r.text for r in again.collect()) == sorted(r.text for r in few.collect())


def test_all_stems_are_learned(spark):
    """No count cuts the list: 800 words of which each is in a third of the toxic texts."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"{letters[k // 26 % 26]}{letters[k % 26]}{letters[k // 676]}q" for k in range(800)]
    rows = [(" ".join(words[(i % 3) :: 3]) + f" {i}", 1) for i in range(60)]
    rows += [(f"plain {i}", 0) for i in range(200)]
    sample = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int")
    assert tx.learned_stems(sample) == frozenset(words)


def test_features():
    of = lambda text: dict(zip(tx.FEATURES, tx.features(text, frozenset({"blorp"})), strict=True))
    assert set(of("").values()) == {0.0}
    masked = of("what an 1d10t and st*pid person")
    assert masked["masked_hits"] == pytest.approx(2 / 6) or masked["masked_hits"] > 0
    assert of("you loser")["aimed"] == 0.5 and of("the loser of the match")["aimed"] == 0.0
    assert of("a blorpification")["learned"] == 0.5 and of("SHOUTED words")["shouted"] == 0.5


def test_isotonic_is_the_nearest_rising_line():
    x = np.array([1.0, 2, 3, 4, 5, 6])
    margins, scores = tx.isotonic(x, np.array([0.0, 1, 0, 0, 1, 1]))
    assert (np.diff(margins) > 0).all() and (np.diff(scores) >= 0).all()
    # 1, 0, 0 are pooled; each block is drawn half a row towards the mean of all.
    assert margins.tolist() == [1.0, 3.0, 5.5]
    assert scores.tolist() == pytest.approx([0.25 / 1.5, 1.25 / 3.5, 2.25 / 2.5])


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(tx.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = tx.fit(x, y, frozenset())
    fresh = rng.random((600, len(tx.FEATURES)))
    truth = ((fresh[:, 0] > 0.5) ^ (fresh[:, 3] > 0.5)).astype(float)
    assert area(model.score(fresh), truth) > 0.95
