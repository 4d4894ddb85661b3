"""Exact deduplication against a persistent digest index, bucketed and sorted by hash.

Everything is built-in column functions; no Python runs on the executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonia.llm.scratch import Scratch

# Buckets of an index; fixed for its life.  An entry is some fifty bytes, so 4,096 buckets hold about a hundred billion
# texts at a gigabyte each.
BUCKETS = 32
# A digest is joined apart from the rest if it holds more than one in HOT_SHARE rows of a batch, so there are fewer
# than HOT_SHARE of them and their table is broadcast with a proven bound.
HOT_SHARE = 1000


def digest(text: Column) -> Column:
    """SHA-256 of the whole text in UTF-8, 32 bytes; NULL reads as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


class DigestIndex:
    """Digests of all texts seen so far: a table bucketed and sorted by digest.

    ``digest, keep_id, keep_row, batch``: the document that stays for a text,
    and the batch that brought it.  The files stay in ``folder``; a session that
    opens the folder again reads the same index.  Entries are only appended, one
    commit a batch.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark = spark
        self.table = f"digests_{uuid.uuid4().hex}"
        place = folder.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds the digests that the index lacks (sort-merge anti-join on the bucketed digest)."""
        fresh = groups.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        fresh.select("digest", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"), F.lit(batch).alias("batch")).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Forgets the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the columns of their digest's group.

    Digests of more than one in HOT_SHARE rows meet their groups in a broadcast
    join, where their rows stay where they are; the others are shuffled.
    """
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") * HOT_SHARE > total
    frequent = groups.where(hot)  # fewer than HOT_SHARE rows
    marked = rows.join(F.broadcast(frequent), "digest", "left")
    columns = [c for c in groups.columns if c != "digest"]
    found = marked.where("group_size IS NOT NULL")
    others = marked.where("group_size IS NULL").drop(*columns).join(groups.where(~hot), "digest")
    return found.unionByName(others)


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs`` (``doc_id, text``).

    1. Every row becomes its id and digest, written once; texts are read no more.
    2. Equal digests are one group (combined before the shuffle): its largest
       ``doc_id`` and its rows in this batch.
    3. Groups that the index lacks are appended to it; then it says of every
       digest which document stays.

    A text that an earlier batch brought keeps that batch's document, and no row
    of this batch is kept; ``group_size`` counts this batch only.  A batch added
    again under its own name has the same result, so a job that died can be run
    again.  NULL text counts as empty.  NULL ids are the smallest: such a row
    stays only where no row of its text has an id, and ``keep_id`` is then NULL.
    Of repeated rows with the largest id just one stays, any of them.  An empty
    table gives no rows.  Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = scratch.keep(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    )
    groups = scratch.keep(
        rows.groupBy("digest").agg(F.max(F.struct(F.col("doc_id").alias("id"), "row")).alias("keep"), F.count("*").alias("group_size"))
    )
    index.append(groups, batch)
    entries = index.entries().withColumnRenamed("digest", "entry")
    # The row numbers are those of this run; an entry of an earlier run of this batch names its document only.
    own = (F.col("batch") == batch) & F.col("keep_id").eqNullSafe(F.col("keep.id"))
    known = scratch.keep(
        groups.join(entries.hint("merge"), F.col("digest") == F.col("entry")).select(
            "digest", "group_size", "keep_id", F.when(own, F.col("keep.row")).alias("keep_row")
        )
    )
    scratch.clear(rows, known)
    return _joined(rows, known).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
