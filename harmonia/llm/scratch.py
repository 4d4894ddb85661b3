"""Tables kept for the length of a job in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from harmonia.session import ensure_checkpoint_dir

_OPENED: ContextVar[list[Scratch] | None] = ContextVar("opened", default=None)


@contextmanager
def opened() -> Iterator[list[Scratch]]:
    """Every scratch opened within, in this thread of control alone."""
    found: list[Scratch] = []
    before = _OPENED.set(found)
    try:
        yield found
    finally:
        _OPENED.reset(before)


class Scratch:
    """Writes tables as Parquet below ``spark.checkpoint.dir`` and reads them back.

    A kept table has no lineage: a lost executor costs a re-read of files, not
    the work before them.  ``clear`` removes the tables that nothing reads any
    more; those that a returned DataFrame still reads stay, and whoever has
    written that DataFrame may clear all of them (see ``opened``).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[tuple[DataFrame, str]] = []
        held = _OPENED.get()
        if held is not None:
            held.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        return self.kept(df)[0]

    def kept(self, df: DataFrame) -> tuple[DataFrame, str]:
        """The table and its folder, for ``drop``."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((found, path))
        return found, path

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.tables = [(df, held) for df, held in self.tables if held != path]

    def clear(self, *still_read: DataFrame) -> None:
        """Drops all tables but those given."""
        for df, path in list(self.tables):
            if not any(df is kept for kept in still_read):
                self.drop(path)
