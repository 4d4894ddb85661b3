"""Joins that keep hot keys apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than this many rows.  The most frequent ones, up
# to MOST_HOT (a proven bound for the broadcast below), are split; AQE handles the rest.
HOT_MIN_ROWS = 1_000_000
MOST_HOT = 1_000


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Keys with at least ``min_rows`` rows, and the pieces to split each into; one scan."""
    return hot_counts(df.groupBy(key).agg(F.count("*").alias("_n")), key, "_n", min_rows)


def hot_counts(counts: DataFrame, key: str, n: str, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Hot keys where the rows of each key are counted already."""
    hot = counts.where(F.col(n) >= min_rows).orderBy(F.desc(n), key).limit(MOST_HOT)
    return hot.select(key, (F.floor(F.col(n) / min_rows) + 1).cast("int").alias("_pieces"))


def join_unique(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    *,
    min_rows: int = HOT_MIN_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join a large table with a table whose ``key`` is unique.

    Rows of hot keys are spread by their input partition over as many pieces as
    their number asks for; the matching right rows are copied to each.  Keys that
    are not hot are joined as usual, and Spark may still turn the join into a
    broadcast join when it measures a small right side.  ``left[key]`` must not
    be NULL (read NULL as the empty text first).  ``hot`` gives the hot keys and
    pieces where they are known already, at most MOST_HOT of them.
    """
    if hot is None:
        hot = hot_keys(left, key, min_rows)
    hot = F.broadcast(hot)
    pieces = F.coalesce("_pieces", F.lit(1))
    salted_left = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.spark_partition_id(), pieces)).drop("_pieces")
    salted_right = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces")
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def last_row_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: the last by ``order``, with ``first_order`` of the key's first row.

    An aggregate, not a window: each task keeps one row per key before the
    shuffle, so a key that holds a third of the rows costs nothing extra.
    """
    rest = [name for name in df.columns if name not in keys]
    grouped = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), order).alias("_row"), F.min(order).alias("first_order")
    )
    return grouped.select(*keys, "_row.*", "first_order")
