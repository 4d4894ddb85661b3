"""Session set-up, lineage cuts and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Plan-time tables are broadcast up to this many rows, and joined as Spark
# chooses beyond it.
BROADCAST_ROW_BOUND = 100_000


def build_session(app_name: str = "harmonia", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is written for.

    AQE sizes the shuffles, splits skewed join partitions and turns a shuffle
    join into a broadcast join only after having measured the side at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-harmonia-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there."""
    return written(df)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: columns are read as needed and sizes are known."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches that Python functions are given hold at most ``rows`` rows, for what is written within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(rows, int(before) if int(before) > 0 else rows))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_reads(spark: SparkSession, rows: int) -> None:
    """From here on the session reads Parquet in batches of at most ``rows`` rows: a batch of long arrays is held whole on the heap.

    Plans are run after their functions have returned, so the setting stays.
    """
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(name, str(min(rows, int(spark.conf.get(name)))))


def parallel(df: DataFrame) -> DataFrame:
    """``df`` in at least as many tasks as there are cores; a table of many files or row groups stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of fixed values or catalogue metadata, broadcast where its size is within the bound."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROW_BOUND else table
