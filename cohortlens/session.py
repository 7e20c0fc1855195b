"""Where intermediate tables live, and which small tables may be broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import literal, number

# Largest lookup that is shipped to every executor; beyond it a shuffle join is used.
BROADCAST_ROWS = 10_000
# Constant tables up to this size become part of the plan; larger ones are sent as data.
INLINE_ROWS = 500


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables that are set aside, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, until Python ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    session = spark.conf.get("spark.app.id", "")
    if session not in _local_folders:
        folder = tempfile.mkdtemp(prefix="cohortlens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_folders[session] = folder
    return _local_folders[session]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, so that every later read sees the same rows.

    Needed where a column depends on physical placement (``spark_partition_id``): recomputing it
    after losing an executor could move rows. The table belongs to the current workspace, or
    else to one of the session's own, see ``session_workspace``.
    """
    return (_current.get() or session_workspace(df.sparkSession)).table(df)


def constants(
    spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str
) -> DataFrame:
    """A table of values known to the driver, such as thresholds, ready to be broadcast."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if len(rows) > INLINE_ROWS:
        return F.broadcast(spark.createDataFrame(list(rows), schema))
    if not rows:
        rows, condition = [[None] * len(schema)], " WHERE false"
    else:
        condition = ""
    text = ", ".join(f"({', '.join(map(_literal, row))})" for row in rows)
    columns = ", ".join(
        f"CAST(c{i} AS {f.dataType.simpleString()}) AS `{f.name}`" for i, f in enumerate(schema)
    )
    names = ", ".join(f"c{i}" for i in range(len(schema)))
    return F.broadcast(spark.sql(f"SELECT {columns} FROM VALUES {text} AS t({names}){condition}"))


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return literal(value)
    return number(value)


def lookup(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, else hand it back as it is.

    At most ``max_rows + 1`` rows reach the driver. The returned frame gives the same join
    result in both cases; without the hint Spark shuffles, and AQE splits skewed keys.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return constants(df.sparkSession, rows, df.schema)


# Most keys of a filter that Spark builds to drop rows before a shuffle; more would let nearly all rows pass.
EARLY_KEYS = 4_000_000


@contextmanager
def early_filter(spark: SparkSession, keys: int) -> Iterator[None]:
    """Until the end of the block, joins with ``keys`` wanted keys may drop other rows before they are moved.

    Spark does that by a Bloom filter on the scan of a large table (its own threshold decides), but by
    default only if the table of keys is under 10 MB. Here the number of keys is known, so the filter is
    made for it, of 8 MB at most; the join makes the result exact.
    """
    name = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {f"{name}creationSideThreshold": "4g", f"{name}expectedNumItems": str(max(keys, 1_000))}
    if keys > EARLY_KEYS:
        wanted = {}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Workspace:
    """What a comparison sets aside while its tables are computed.

    Its tables are managed tables of a database in the shared folder, so dropping the database removes
    their files on any storage. ``with Workspace(spark) as workspace`` frees them at the end.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._database: str | None = None
        self._tables = 0
        self._kept: list[DataFrame] = []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    @contextmanager
    def current(self) -> Iterator[Workspace]:
        """Until the end of the block, ``materialise`` writes into this workspace."""
        token = _current.set(self)
        try:
            yield self
        finally:
            _current.reset(token)

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` to the shared folder as parquet and read it back.

        What led to it is never computed again, and later passes read only their columns.
        """
        if self._database is None:
            self._database = f"cohortlens_{uuid.uuid4().hex}"
            location = literal(f"{shared_folder(self.spark)}/{self._database}")
            self.spark.sql(f"CREATE DATABASE {self._database} LOCATION {location}")
        self._tables += 1
        name = f"{self._database}.t{self._tables}"
        df.write.format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def keep(self, df: DataFrame) -> DataFrame:
        """Keep ``df`` in memory, spilling to disk; lost parts are computed again."""
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self._kept[-1]

    def free(self, df: DataFrame) -> None:
        """Free a kept frame that is not needed any more."""
        df.unpersist()
        self._kept = [frame for frame in self._kept if frame is not df]

    def release(self) -> None:
        """Free kept frames and remove the tables written here. Results must be read before."""
        for frame in self._kept:
            frame.unpersist()
        self._kept.clear()
        if self._database is not None:
            self.spark.sql(f"DROP DATABASE IF EXISTS {self._database} CASCADE")
            self._database = None


_current: ContextVar[Workspace | None] = ContextVar("workspace", default=None)
_of_sessions: dict[str, Workspace] = {}


def session_workspace(spark: SparkSession) -> Workspace:
    """The workspace of steps that are called outside any other; whoever reads their results may
    release it afterwards."""
    return _of_sessions.setdefault(spark.conf.get("spark.app.id", ""), Workspace(spark))
