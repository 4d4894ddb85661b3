"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

Everything is built-in column functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
SHARDS = 16


def virtual_slot(doc_id: Column, text: Column) -> Column:
    """The slot of a record for good: a hash of its id, or of its text where it has no id."""
    return F.pmod(F.xxhash64(F.coalesce(F.xxhash64(doc_id), F.xxhash64(text))), F.lit(SLOTS)).cast("int")


def records(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of every row; the size of a text is its UTF-8 bytes plus 1."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(
        doc_id.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        virtual_slot(F.when(doc_id.isNotNull(), doc_id), text).alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of every slot, empty ones included; combined before the shuffle."""
    every = rows.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("virtual_slot"))
    held = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    zero = F.lit(0).cast("long")
    return every.join(held, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("rows", zero).alias("rows")
    )


def initial_map(spark: SparkSession, shards: int) -> DataFrame:
    """Version 1: slots dealt in turn."""
    slot = F.col("id").cast("int")
    return spark.range(SLOTS).select(
        slot.alias("virtual_slot"), (slot % shards).alias("shard"), F.lit(1).alias("version")
    )


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, for the given number of shards.

    A shard keeps its largest slots as long as they fit into an equal share of
    the bytes.  Only the other slots move (all slots of a shard that no longer
    exists), the largest first, each to the shard with the least bytes so far;
    ties go to the lower slot and shard.  The work is bounded by SLOTS rows.
    """
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    share = F.ceil(F.sum("bytes").over(Window.partitionBy(F.lit(0))) / shards)
    held = slot_map.join(F.broadcast(sizes), "virtual_slot").select(
        "*", F.sum("bytes").over(largest_first).alias("upto"), share.alias("share")
    ).withColumn("stays", (F.col("upto") <= F.col("share")) & (F.col("shard") < shards))
    gathered = held.agg(
        F.collect_list(F.when(F.col("stays"), F.struct("shard", "bytes"))).alias("kept"),
        F.array_sort(
            F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("minus"), F.col("virtual_slot").alias("slot"))))
        ).alias("moving"),
        F.max("version").alias("version"),
    )
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda k: F.aggregate(
            F.filter("kept", lambda x: x["shard"] == k), F.lit(0).cast("long"), lambda total, x: total + x["bytes"]
        ),
    )
    lightest = lambda loads: F.array_position(loads, F.array_min(loads)).cast("int") - 1
    placed = F.aggregate(
        "moving",
        F.struct(loads.alias("loads"), F.array().cast("array<struct<slot:int,shard:int>>").alias("placed")),
        lambda acc, m: F.struct(
            F.transform(
                acc["loads"],
                lambda load, k: F.when(k == lightest(acc["loads"]), load - m["minus"]).otherwise(load),
            ).alias("loads"),
            F.concat(
                acc["placed"], F.array(F.struct(m["slot"].alias("slot"), lightest(acc["loads"]).alias("shard")))
            ).alias("placed"),
        ),
        lambda acc: acc["placed"],
    )
    moved = gathered.select(F.explode(placed).alias("to")).select(
        F.col("to.slot").alias("virtual_slot"), F.col("to.shard").alias("to_shard")
    )
    return slot_map.join(F.broadcast(moved), "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("to_shard", "shard").cast("int").alias("shard"), (F.col("version") + 1).alias("version")
    )


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Adds a version to the stored map; an existing version is never overwritten."""
    slot_map.write.partitionBy("version").mode("append").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest one by default."""
    stored = spark.read.parquet(folder)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def assigned(docs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text``) with its shard and its place there.

    The shard is the one of the row's virtual slot.  ``slot`` counts the rows of
    a shard from 0 without gaps: slots follow one another, and rows of a slot go
    by ``doc_id, text_crc32, size``.  Each window holds one of SLOTS slots, so no
    task sees a whole shard.  NULL texts have size 1 and checksum 0; NULL ids go
    by their text's hash; repeated rows each have a place.  Other columns are
    not read.
    """
    rows = records(docs)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_map.join(F.broadcast(slot_sizes(rows)), "virtual_slot").withColumn(
        "base", F.coalesce(F.sum("rows").over(before), F.lit(0))
    ).select("virtual_slot", "shard", "version", "base")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    # SLOTS rows: a proven bound.
    return rows.withColumn("nth", F.row_number().over(within)).join(F.broadcast(bases), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"),
        "virtual_slot", F.col("version").alias("map_version"),
    )


def shard(docs: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """All rows over ``shards`` shards of near equal bytes (law ``bytes``); the map is stored in ``folder``.

    Version 1 deals slots in turn, version 2 is balanced by the bytes of the
    slots and used here.
    """
    spark = docs.sparkSession
    first = initial_map(spark, shards)
    save_map(first, folder)
    save_map(rebalanced(first, slot_sizes(records(docs)), shards), folder)
    return assigned(docs, load_map(spark, folder)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
