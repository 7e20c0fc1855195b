import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from cohortlens.llm import mixing, simhash_dedup, toxicity
from cohortlens.llm import pipeline as cp
from cohortlens.llm.common import staged
from tests.llm import brute


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage gets and returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(staged(stage(spark, out[-1], sf_dir)))
    return out


def test_stages_are_in_order():
    assert [name for name, _ in cp.STAGES] == [
        "toxicity", "exact dedup", "SimHash near-dedup", "mixing", "SentencePiece"
    ]


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:5])


def test_toxic_documents_go(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = toxicity.toxicity(stages[0], labels)
    kept = {r.doc_id for r in scores.where("predicted = 0").collect()}
    assert {i for i, _ in pairs(stages[1])} == kept
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert clean <= kept


def test_one_of_equal_texts_stays(stages):
    groups = brute.exact_groups(pairs(stages[1]))
    assert sorted(i for i, _ in pairs(stages[2])) == sorted({keep for _, keep, _, _ in groups})


def test_one_of_near_copies_stays(stages):
    groups = brute.near_groups(pairs(stages[2]))
    assert sorted(i for i, _ in pairs(stages[3])) == sorted({c for _, _, c in groups})


def test_rows_come_as_often_as_the_mix_takes_them(stages):
    taken = {r.doc_id: r.repeats for r in mixing.mixed(stages[3]).collect() if r.repeats}
    assert Counter(i for i, _ in pairs(stages[4])) == taken


def test_ids_of_all_rows(stages):
    rows = stages[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in pairs(stages[4]))
    assert all(r.round_trip for r in rows)


def test_run_is_all_stages(spark, sf_dir, stages):
    found = sorted((r.doc_id, tuple(r.ids)) for r in cp.run(spark, sf_dir).collect())
    assert found == sorted((r.doc_id, tuple(r.ids)) for r in stages[5].collect())


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 0), (14, 1), (None, 1)], "doc_id long, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    for docs in (odd_docs, no_docs):
        for name, stage in cp.STAGES:
            out = staged(stage(spark, docs, str(tmp_path)))
            if name != "SentencePiece":
                assert out.columns == docs.columns
                docs = out
    copies = staged(cp.drop_copies(spark, odd_docs, str(tmp_path)))
    kept = {(keep, digest) for _, keep, _, digest in brute.exact_groups(pairs(odd_docs))}
    assert copies.count() == len(kept)
    near = staged(cp.drop_near_copies(spark, odd_docs, str(tmp_path)))
    assert near.count() == simhash_dedup.near_duplicates(odd_docs).select("root").distinct().count()


def test_queries_are_registered():
    names = [n for n in entry_point.queries() if n.startswith("op") or n == "pipeline"]
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


def test_the_rest_works_without_this_part(tmp_path):
    here = Path(entry_point.__file__).parent
    for name in ("cohortlens", "verification"):
        shutil.copytree(here / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1') for n in e.queries()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0 and run.stdout.strip().endswith("False"), run.stderr
