"""Ordered event pairs per worker, counted without building the pairs.

Events are first reduced to one row per worker and day, with a count per event.
The number of pairs whose gap lies in ``[low, high]`` is then, summed over the
days of the first event,

    count(first) * (running count(then) up to day + high
                    - running count(then) up to day + low - 1)

Both running counts are growing range frames of one window, so a worker with a
third of all rows costs its number of distinct days, not the square of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harmonia.functions.text import plain_normalize
from harmonia.plans.cohort_definition import SequenceDefinition

UNBOUNDED = None


def gap_ranges(sequence: SequenceDefinition, compat: bool = False) -> list[tuple[int | None, int | None]]:
    """Allowed values of ``then - first`` in days, as closed ranges (None = open end).

    ``same_day`` without ``max_days`` means the same day; with ``compat`` it
    accepts any gap.
    """
    relation = plain_normalize(sequence.relation)
    low = 0 if sequence.min_days is None else sequence.min_days
    high = sequence.max_days
    if relation == "strictlybefore" and low == 0:
        low = 1
    if relation == "sameday" and high is None and not compat:
        high = 0
    if high is not None and high < low:
        return []
    if relation == "sameday":
        if low <= 0:
            return [] if high is not None and high < 0 else [(None if high is None else -high, high)]
        return [(low, high), (None if high is None else -high, -low)]
    if relation == "after":
        return [(None if high is None else -high, -low)]
    return [(low, high)]


def pairs_of_day(first: Column, then: Column, ranges: list[tuple[int | None, int | None]]) -> Column:
    """Pairs that start on this row's day; rows are one worker and day each."""
    by_worker = Window.partitionBy("travailleur_id")
    running = by_worker.orderBy("_day")

    def up_to(offset: int) -> Column:
        frame = running.rangeBetween(Window.unboundedPreceding, offset)
        return F.coalesce(F.sum(then).over(frame), F.lit(0))

    partners = F.lit(0).cast("bigint")
    for low, high in ranges:
        upper = F.sum(then).over(by_worker) if high is None else up_to(high)
        lower = F.lit(0) if low is None else up_to(low - 1)
        partners = partners + upper - lower
    return first.cast("decimal(38,0)") * partners.cast("decimal(38,0)")


def sequence_pairs(
    days: DataFrame,
    sequences: tuple[SequenceDefinition, ...],
    event_columns: dict[str, str],
    compat: bool = False,
) -> DataFrame:
    """Per worker: records of each event and pairs of each sequence.

    ``days`` holds ``travailleur_id``, ``event_date`` and a count column per
    event.  An event name that was never defined counts as an event without
    records.
    """
    none = F.lit(0).cast("bigint")
    dated = days.withColumn("_day", F.datediff("event_date", F.lit("1970-01-01").cast("date")))

    def counted(name: str) -> Column:
        return F.col(event_columns[name]) if name in event_columns else none

    pairs = {
        f"pairs_{i}": pairs_of_day(counted(s.first), counted(s.then), gap_ranges(s, compat))
        for i, s in enumerate(sequences)
    }
    return (
        dated.select("travailleur_id", *event_columns.values(), *[c.alias(n) for n, c in pairs.items()])
        .groupBy("travailleur_id")
        .agg(
            *[F.sum(c).alias(c) for c in event_columns.values()],
            *[F.sum(n).cast("decimal(38,0)").alias(n) for n in pairs],
        )
    )
