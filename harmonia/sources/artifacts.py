"""Artefacts: tables out to Parquet, CSV, JSON and JSON lines, and back."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_artifacts(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table as ``folder/name`` in Parquet; an empty table keeps its schema."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """The named tables that exist; the others are left out, not an error."""
    return {
        name: spark.read.parquet(f"{folder}/{name}")
        for name in names
        if path_exists(spark, f"{folder}/{name}")
    }


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited text with a header; flags and dates as text, NULL as the empty text."""
    cells = [
        F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name)
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    ]
    df.select(*cells).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row, keys sorted."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)
