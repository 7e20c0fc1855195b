"""Checked CSV reading."""

import pytest
from pyspark.sql import types as T

from cohortlens.session import Workspace
from cohortlens.sources.tables import read_csv_checked

SCHEMA = T.StructType().add("User_ID", "long").add("score", "double").add("name", "string")


@pytest.fixture
def read(spark, tmp_path):
    def run(**files):
        for name, text in files.items():
            (tmp_path / f"{name}.csv").write_text(text)
        if not files:
            (tmp_path / "empty.csv").write_text("")
        with Workspace(spark) as workspace, workspace.current():
            rows, rejected = read_csv_checked(spark, str(tmp_path), SCHEMA)
            assert rows.columns == ["user_id", "score", "name"] and rejected.columns == ["file", "line"]
            lines = [(r.file.rsplit("/", 1)[1], r.line) for r in rejected.collect()]
            return sorted(map(tuple, rows.collect()), key=str), sorted(lines)

    return run


def test_lines_that_are_no_rows(read):
    rows, rejected = read(a='user_id,score,name\n1,2.5,"x,y"\n2,abc,z\n3,1\n4,1.0,a,b\n\n5,,q\nx,3,w\n6,NaN,n\n')
    assert [r[0] for r in rows] == [1, 5, 6] and rows[0] == (1, 2.5, "x,y") and rows[1] == (5, None, "q")
    assert rejected == [("a.csv", "2,abc,z"), ("a.csv", "3,1"), ("a.csv", "4,1.0,a,b"), ("a.csv", "x,3,w")]


def test_files_with_other_headers(read):
    rows, rejected = read(
        a="USER_ID,Score,Name\n1,1,a\n", b="name,more,user_id\nb,x,2\n", c="score,user_id\n3.5,3\n1\n",
        d="_line,user_id\nq,4\n", e="user_id,score,name\n", f="other\nz\n",
    )
    assert rows == [(1, 1.0, "a"), (2, None, "b"), (3, 3.5, None), (4, None, None), (None, None, None)]
    assert rejected == [("c.csv", "1")]


def test_headers_of_large_files(spark, read, monkeypatch):
    """Files that are read in several splits, out of order."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows, rejected = read(
            a="user_id,score,name\n" + "".join(f"{i},{i}.5,n{i}\n" for i in range(100)),
            b="score,user_id\n" + "".join(f"{i}.5,{i + 100}\n" for i in range(50)) + "bad\n",
        )
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r[0] for r in rows) == list(range(150)) and rejected == [("b.csv", "bad")]
    assert all(r[1] == r[0] % 100 + 0.5 for r in rows)


def test_no_lines(read):
    assert read() == ([], [])
