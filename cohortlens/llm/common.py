"""What the operators share: tables they read, tables they set aside, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import shared_folder

# ASCII white space as the contracts list it: [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless their path has it already.

    Workers inherit the driver's ``PYTHONPATH``, and in local sessions its folder.
    """
    root = Path(__file__).resolve().parents[2]
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if "site-packages" in root.parts or root in {Path(p).resolve() for p in (os.getcwd(), *paths)}:
        return
    session = spark.conf.get("spark.app.id", "")
    if session in _shipped:
        return
    packed = Path(tempfile.mkdtemp(prefix="cohortlens-code-")) / "cohortlens_code.zip"
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted((root / "cohortlens").rglob("*.py")):
            archive.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(packed))
    _shipped.add(session)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator works on, so that other columns cannot clash with its own.

    Missing columns count as null.
    """
    ship_code(docs.sparkSession)
    kinds = {"doc_id": "bigint", "text": "string", "source": "string"}
    have = set(docs.columns)
    return docs.select(
        *(
            (F.col(name) if name in have else F.lit(None)).cast(kinds[name]).alias(name)
            for name in ("doc_id", "text", *more)
        )
    )


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as parquet and read it back.

    What led to it is never computed again; a lost executor costs at most the tasks after it.
    """
    folder = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.staged_in = folder
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of ``staged`` frames that nothing reads any more."""
    for df in frames:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df.staged_in)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def by_text(
    df: DataFrame, work: Callable[[list[str]], list], schema: str, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns and what ``work`` finds for each text, Arrow batch by Arrow batch.

    ``df`` needs the ``keep`` columns and ``text``; ``work`` gets the texts of a slice of rows (null
    as the empty string) and returns one list or Arrow array for each column of ``schema``.
    Slices hold about ``SLICE_CHARS`` bytes, so one batch of long texts does not pile up results.
    """
    kept, new = df.select(*keep, "text"), T.StructType.fromDDL(schema)
    names = new.names
    full = T.StructType([*kept.schema.fields[: len(keep)], *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(len(keep)).to_pylist()]
                found = work(texts)
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in found]
                columns = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, *arrays], names=[*keep, *names])

    return kept.mapInArrow(run, full)


def drawn(rows: DataFrame, most: int, *key: str, by: str = "true") -> DataFrame:
    """At most ``most`` rows for each value of the condition ``by``, the same on each run: those with
    the smallest hashes of ``key``.

    Rows are counted first, and a bound on the hash leaves about twice as many as are wanted, so few
    rows of each task take part in the final order, whatever the size of the table.
    """
    lot = F.pmod(F.xxhash64(*key), F.lit(1 << 31))
    counts = {r.kind: r.n for r in rows.groupBy(F.expr(by).alias("kind")).agg(F.count("*").alias("n")).collect()}
    near = F.lit(False)
    for kind, n in counts.items():
        bound = int(min(1.0, 2 * most / n) * (1 << 31)) + 1
        near |= F.expr(by).eqNullSafe(F.lit(kind)) & (lot < bound)
    few = staged(rows.where(near))
    out = few.limit(0)
    for kind in counts:
        part = few.where(F.expr(by).eqNullSafe(F.lit(kind)))
        out = out.union(part.orderBy(lot, *key).limit(most))
    return out


# Bytes of texts that are worked on at once; a longer text makes a slice of its own.
SLICE_CHARS = 4 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    rows = max(1, batch.num_rows * SLICE_CHARS // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def text_hash() -> Column:
    """Tells texts of one id apart; 64 bits do, as few rows share an id."""
    return F.xxhash64("text")


def whole_row(docs: DataFrame) -> Column:
    """All columns, whatever they are called, as one struct ``row``."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")


def keep_one(docs: DataFrame, chosen: DataFrame, repeats: bool = False) -> DataFrame:
    """The row of ``docs`` for each ``doc_id`` and ``text_hash`` of ``chosen``, all columns.

    Rows that are equal in both are kept once; each task lets one of them through before the shuffle, so
    many equal rows do not meet. With ``repeats``, ``chosen`` has a column of that name, and rows come
    that many times. Null ids match each other.
    """
    keys = ("no_id", "id", "hash")
    key = (
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
    )
    text = F.col("text").cast("string")
    rows = docs.select(*key, F.xxhash64(text).alias("hash"), whole_row(docs))
    wanted = chosen.select(*key, F.col("text_hash").alias("hash"), *(["repeats"] if repeats else []))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("no_id"))
    kept = rows.withColumn("turn", turn).where("turn = 1").join(wanted, list(keys))
    if repeats:
        kept = kept.where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "repeats")))
    return kept.select("row.*")
