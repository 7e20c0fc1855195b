"""Sharding over fixed virtual slots, with a slot-to-shard map that is edited to rebalance.

Records hash into ``SLOTS`` slots, for good. Bytes are summed per slot, and a map says which shard
holds a slot. Rebalancing writes the next version of the map: each shard keeps its largest
slots up to its share, the others go, largest first, to the shard with the least bytes. The map
has ``SLOTS`` rows whatever the size of the data; rows only ever move with their slot. All versions
are kept in a folder, and a later run goes on from the latest one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import documents, staged, table
from cohortlens.session import shared_folder

SLOTS = 4096
SHARDS = 8
# Equal rows that one row of the plan stands for when they are written out.
RUN = 100_000


def virtual_slot(*record: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*record), F.lit(slots)).cast("int")


def sized_records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Size, checksum and slot of records, and how many rows are equal in them and in their id.

    A null text has no bytes; its checksum is 0. The slot comes from id and text, so a repeated id,
    or null as the id of many rows, is spread. Rows that are equal in both share a slot by force;
    they are counted map-side and travel as one row.
    """
    records = documents(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        virtual_slot(F.col("doc_id"), F.col("text"), slots=slots).alias("virtual_slot"),
    )
    return records.groupBy(*records.columns).agg(F.count("*").alias("n"))


def slot_loads(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones too."""
    loads = records.groupBy("virtual_slot").agg(
        F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")
    )
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return F.broadcast(every).join(loads, "virtual_slot", "left").na.fill(0)


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt out in turn."""
    return spark.range(slots).select(
        F.lit(0).alias("version"),
        F.col("id").cast("int").alias("virtual_slot"),
        (F.col("id") % shards).cast("int").alias("shard"),
    )


def rebalanced(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map, for ``shards`` shards and the bytes that slots hold now.

    Slots stay where they are unless their shard holds more than its share or is gone. More
    shards than before take slots from all others. An empty table leaves the map as it is.
    """
    by_size = (F.col("bytes").desc(), F.col("virtual_slot"))
    held = F.sum("bytes").over(
        Window.partitionBy("shard").orderBy(*by_size).rowsBetween(Window.unboundedPreceding, 0)
    )
    share = F.sum("bytes").over(Window.partitionBy()) / shards
    placed = slot_map.join(loads, "virtual_slot").select(
        "version", "virtual_slot", "shard", "bytes", held.alias("held"), share.alias("share")
    )
    stays = (F.col("shard") < shards) & ((F.col("held") <= F.col("share")) | (F.col("bytes") == 0))
    placed = placed.select("*", stays.alias("stays"))

    # One row: bytes that stay in each shard, and the slots that leave, the largest first.
    packed = placed.agg(
        *(
            F.coalesce(
                F.sum(F.when(F.col("stays") & (F.col("shard") == shard), F.col("bytes"))), F.lit(0)
            ).alias(f"shard{shard}")
            for shard in range(shards)
        ),
        F.sort_array(
            F.collect_list(
                F.when(~F.col("stays"), F.struct(-F.col("bytes"), F.col("virtual_slot")))
            )
        ).alias("leaving"),
    ).select(F.array(*(f"shard{shard}" for shard in range(shards))).alias("loads"), "leaving")
    least = "CAST(array_position(a.loads, array_min(a.loads)) - 1 AS INT)"
    moved = packed.selectExpr(
        f"""aggregate(leaving,
              named_struct('loads', loads, 'moves',
                CAST(array() AS ARRAY<STRUCT<virtual_slot: INT, shard: INT>>)),
              (a, slot) -> named_struct(
                'loads', transform(a.loads, (held, i) -> held - IF(i = {least}, slot.col1, 0)),
                'moves', a.moves || array(named_struct(
                  'virtual_slot', slot.virtual_slot, 'shard', {least}))),
              a -> a.moves) AS moves"""
    ).selectExpr("inline(moves)")
    return placed.join(
        moved.withColumnRenamed("shard", "to"), "virtual_slot", "left"
    ).select(
        (F.col("version") + 1).alias("version"),
        "virtual_slot",
        F.coalesce("to", "shard").cast("int").alias("shard"),
    )


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Add the map to the versions kept in ``folder``; a version that is written again is replaced."""
    slot_map.write.partitionBy("version").mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    found = spark.read.parquet(folder).where(F.col("version") == version)
    return found.select("version", "virtual_slot", "shard")


def latest_version(spark: SparkSession, folder: str) -> int | None:
    """The last version kept in ``folder``; None if it holds none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return None
    return spark.read.parquet(folder).agg(F.max("version")).first()[0]


def next_map(loads: DataFrame, folder: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Edit the latest map in ``folder`` for the bytes that slots hold now, store it as the next
    version, and return it as it was stored. A folder without maps gets version 0 first."""
    spark = loads.sparkSession
    version = latest_version(spark, folder)
    if version is None:
        version = 0
        store_map(first_map(spark, shards, slots), folder)
    # Set aside first, as the folder is read and written.
    store_map(staged(rebalanced(load_map(spark, folder, version), loads, shards)), folder)
    return load_map(spark, folder, version + 1)


def placed_records(records: DataFrame, loads: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard, and its place in it, counted from 0 without gaps.

    Places run through the slots of a shard in turn. Different rows are numbered inside slots only;
    what comes before a slot is known from the counts of slots. Equal rows take as many places as
    they are, and are written out by runs, so that many of them become many tasks' work.
    """
    before = F.sum("rows").over(
        Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = slot_map.join(loads, "virtual_slot").select(
        "virtual_slot", "shard", "version", F.coalesce(before, F.lit(0)).alias("start")
    )
    within = F.sum("n").over(
        Window.partitionBy("virtual_slot")
        .orderBy("doc_id", "text_crc32", "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    # One row per slot of the map.
    numbered = records.withColumn("end", within).join(F.broadcast(starts), "virtual_slot")
    numbered = staged(numbered.withColumn("first", F.expr("start + end - n")).drop("start", "end"))
    runs = numbered.where(F.col("n") > RUN).withColumn(
        "run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})"))
    ).repartition("virtual_slot", "run")
    runs = runs.selectExpr(
        *(c for c in numbered.columns if c not in ("first", "n")),
        f"first + run * {RUN} AS first",
        f"least({RUN}L, n - run * {RUN}) AS n",
    )
    rows = numbered.where(F.col("n") <= RUN).unionByName(runs)
    return rows.withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)"))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None
) -> DataFrame:
    """Place all records by the ``bytes`` law, with the next version of the map kept in ``maps``.

    The latest map there is rebalanced to the bytes of these records. Without ``maps`` the versions are
    kept in a new place in the shared folder: 0, and 1 that is used. Shards come out equal in bytes to
    within one slot, or one record that is larger than a shard's share. Empty tables give no
    rows; null ids and texts and repeated rows are placed like any others; columns other than id and
    text are not looked at.
    """
    if maps is None:
        maps = f"{shared_folder(docs.sparkSession)}/llm-maps-{uuid.uuid4().hex}"
    records = staged(sized_records(docs, slots))
    loads = staged(slot_loads(records, slots))
    return placed_records(records, loads, next_map(loads, maps, shards, slots))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
