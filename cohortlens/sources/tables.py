"""Reading play tables, results logs and cohort files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.model import RESULTS
from cohortlens.session import materialise


def lower_case(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def read_plays(spark: SparkSession, source: str) -> DataFrame:
    """The play table: a catalog table name, or a path to parquet.

    Written with ``partitionBy('yyyy', 'mm')``, period filters read only matching folders.
    """
    return lower_case(_open(spark, source))


def read_results(spark: SparkSession, source: str) -> DataFrame:
    """The results log, reduced to what numbers sessions."""
    return lower_case(_open(spark, source)).select(*RESULTS.names)


def _open(spark: SparkSession, source: str) -> DataFrame:
    if "/" in source:
        return spark.read.parquet(source)
    return spark.table(source)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header, names in lower case.

    Without a schema it is inferred, which reads the files twice. A schema is matched by name, in any
    order and case; columns that the files lack are NULL, others are left out. Files of one folder
    that differ in their headers raise an error, and values that don't parse are NULL: see
    ``read_csv_checked`` for both.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        return lower_case(reader.option("inferSchema", True).csv(path))
    wanted = {field.name.lower(): field.dataType for field in schema}
    # Reads the header only.
    header = reader.csv(path).columns
    kinds = [T.StructField(c, wanted.get(c.lower(), T.StringType())) for c in header]
    found = lower_case(reader.schema(T.StructType(kinds)).option("enforceSchema", False).csv(path))
    return found.select(
        *[
            (F.col(f"`{c}`") if c in found.columns else F.lit(None).cast(kind)).alias(c)
            for c, kind in wanted.items()
        ]
    )


def read_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """Rows of a folder of CSV files, and the lines that are none: too short, too long, or of other types.

    Each file is read by its own header. Files that have the columns in another order or case, lack some, or
    have more, are united by name; columns that a file lacks are NULL. Rejected lines come as ``file`` and
    ``line``, whole, so that they can be counted, mended and read again; no line is in both tables. A
    first pass over the lines finds the headers; parsing is done once, and what it gives is set aside.
    """
    names = [field.name.lower() for field in schema]
    kinds = dict(zip(names, (field.dataType for field in schema)))
    parts = [
        _parse(spark, files, kinds) for files in _files_by_header(spark, path)
    ]
    empty = spark.createDataFrame([], T.StructType([*(T.StructField(n, kinds[n]) for n in names), *REJECTED]))
    parsed = materialise(reduce(DataFrame.unionByName, parts, empty))
    rows = parsed.filter("line IS NULL").select(*names)
    return rows, parsed.filter("line IS NOT NULL").select("file", "line")


REJECTED = T.StructType().add("file", T.StringType()).add("line", T.StringType())


def _files_by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """Files of the folder and below, those with equal first lines together.

    Lines of a file's first split are numbered in their order, so the first one needs no sort. One row per
    file reaches the driver, as any listing does.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    first = (
        lines.select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.monotonically_increasing_id().alias("place"),
            F.col("_metadata.file_block_start").alias("start"),
        )
        .filter("start = 0")
        .groupBy("file")
        .agg(F.min_by("value", "place").alias("header"))
    )
    groups: dict[str, list[str]] = {}
    for row in sorted(first.collect()):
        groups.setdefault(row["header"], []).append(row["file"])
    return list(groups.values())


def _parse(spark: SparkSession, files: list[str], kinds: dict[str, T.DataType]) -> DataFrame:
    """Wanted columns of files with one header, and where a line is no row, the line."""
    header = spark.read.option("header", True).csv(files[0]).columns
    line = "_line"
    while line in map(str.lower, header):
        line = f"_{line}"
    own = [T.StructField(c, kinds.get(c.lower(), T.StringType())) for c in header]
    found = (
        spark.read.schema(T.StructType([*own, T.StructField(line, T.StringType())]))
        .options(header=True, enforceSchema=False, mode="PERMISSIVE")
        .options(columnNameOfCorruptRecord=line, columnPruning=False)
        .csv(files)
    )
    have = {c.lower(): c for c in header}
    return found.select(
        *[
            (F.col(f"`{have[c]}`") if c in have else F.lit(None).cast(kind)).alias(c)
            for c, kind in kinds.items()
        ],
        F.col("_metadata.file_path").alias("file"),
        # Spark does not read the line alone, which would be all of a file without a wanted column.
        F.when(F.col(line).isNull() & F.col(f"`{header[0]}`").isNull(), None).otherwise(F.col(line)).alias("line"),
    )


def as_plays(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a declared schema, adding columns that are missing as NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
