"""Which columns of which sources hold the same keys, and in which direction they join.

Overlaps come from an inverted index: value -> set of columns that hold it.
Values with the same column set are counted together first.  Join candidates
need a large share of the smaller column, so its rarest values tell which
columns can be its partners, and only these pairs are counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.functions.keys import stable_id
from harmonia.functions.matching import name_ratio, uniqueness_ratio
from harmonia.functions.text import normalize_key
from harmonia.operators.profiling import ValueCounts, cells, marked
from harmonia.session import written
from harmonia.sources.exports import SourceTable

SIDE = ("source_ref", "column", "row_count", "distinct_count", "uniqueness_ratio", "inferred_entities")


def joinable_columns(columns: DataFrame, sources: DataFrame) -> DataFrame:
    """Columns that may be keys: not S4, of a key-like type, with values."""
    context = sources.select("source_ref", "source_position", "inferred_entities")
    return (
        columns.where(
            (F.col("sensitivity") != "S4")
            & F.col("inferred_type").isin(*fixed.JOINABLE_TYPES)
            & (F.size("value_sample") > 0)
        )
        .join(context, "source_ref")
        .withColumn("uniqueness_ratio", uniqueness_ratio(F.col("distinct_count"), F.col("row_count")))
    )


# Hashes of values are dealt to so many parts, so that a share of a column's values can be chosen without ranking them.
PARTS = 64


def _column_values(rows: DataFrame) -> DataFrame:
    """(column_id, value) of values that are not empty.  A long value goes by its head and digest, which no short one equals."""
    held = rows.where(F.col("value") != "")
    return held.select(F.struct("source", "position").alias("column_id"), F.concat("value", F.coalesce(F.hex("digest"), F.lit(""))).alias("value"))


def distinct_values(counts: ValueCounts) -> DataFrame:
    """Distinct (column_id, value) of all columns."""
    return _column_values(counts.rows)


def cell_values(tables: Iterable[SourceTable]) -> DataFrame:
    """(column_id, value) of every cell, repeats and all."""
    return _column_values(marked(cells(list(tables))))


# Columns whose flags one number holds.
FLAGS = 63


def column_ids(values: DataFrame) -> list[tuple[int, int]]:
    """The columns of some values: catalogue metadata."""
    return sorted((r["source"], r["position"]) for r in values.select("column_id.*").distinct().collect())


def column_sets(values: DataFrame, ids: list[tuple[int, int]]) -> DataFrame:
    """Values held by several of the columns ``ids``, as (columns, part, n): how many of each set of columns, by part of their hash.

    A set is flags in whole numbers, one for every 63 columns, so repeated
    values are combined before their only shuffle.
    """
    first, number = [0] * (max((s for s, _ in ids), default=0) + 1), 0
    for source in range(len(first)):
        first[source] = number
        number += max((p + 1 for s, p in ids if s == source), default=0)
    at = F.element_at(F.array(*map(F.lit, first)), F.col("column_id.source") + 1) + F.col("column_id.position")
    flags = [f"flags_{k}" for k in range(max(1, -(-number // FLAGS)))]
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at") % FLAGS)
    held = [F.bit_or(F.when(F.floor(F.col("at") / FLAGS) == k, bit).otherwise(F.lit(0).cast("bigint"))).alias(name) for k, name in enumerate(flags)]
    sets = (
        values.select("value", at.alias("at")).groupBy("value").agg(*held)
        .where(reduce(Column.__add__, [F.bit_count(name) for name in flags]) > 1)
        .groupBy(*flags, F.pmod(F.xxhash64("value"), F.lit(PARTS)).cast("int").alias("part"))
        .agg(F.count("*").alias("n"))
    )

    def column(source: int, position: int) -> Column:
        place = first[source] + position
        there = F.getbit(flags[place // FLAGS], F.lit(place % FLAGS)) == 1
        return F.when(there, F.struct(F.lit(source).alias("source"), F.lit(position).alias("position")))

    columns = F.array_compact(F.array(*(column(*x) for x in ids))) if ids else F.array().cast("array<struct<source:int,position:int>>")
    return sets.select(columns.alias("columns"), "part", "n")


def overlaps(values: DataFrame, ids: list[tuple[int, int]] | None = None) -> DataFrame:
    """(left, right, overlap) of all columns of different sources that share a value; ids are (source, position) structs.

    Values may repeat.  ``ids`` names the columns where they are known.
    """
    sets = column_sets(values, column_ids(values) if ids is None else ids).groupBy("columns").agg(F.sum("n").alias("n"))
    pairs = sets.select("n", "columns", F.posexplode("columns").alias("at", "left")).select(
        "n", "left", F.explode(F.slice("columns", F.col("at") + 2, F.size("columns"))).alias("right")
    )
    return _of_two_sources(pairs).groupBy("left", "right").agg(F.sum("n").alias("overlap"))


def _of_two_sources(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("left.source") != F.col("right.source"))


def likely_overlaps(values: DataFrame, least_ratio: float) -> DataFrame:
    """``overlaps`` of at least ``least_ratio`` of the smaller column's values.

    If so many of its values are held by the other column, then one of any
    ``1 + (1 - least_ratio) * size`` of them is.  The rarest are taken, those
    that the fewest columns hold: mostly values of the column alone, which pair
    it with nothing.  Only columns that meet there are pairs, and these are
    counted in full.
    """
    sizes = written(values.groupBy("column_id").agg(F.count("*").alias("size")))
    sets = written(column_sets(values, column_ids(sizes)))
    member = sets.select("columns", "part", "n", F.size("columns").alias("holders"), F.explode("columns").alias("column_id"))
    cells = member.groupBy("column_id", "holders", "part").agg(F.sum("n").alias("n"))
    alone = sizes.join(cells.groupBy("column_id").agg(F.sum("n").alias("shared")), "column_id").select(
        "column_id", (F.col("size") - F.col("shared")).alias("alone"), (F.floor((1 - least_ratio) * F.col("size") + 1e-9) + 1).alias("needed")
    )
    before = Window.partitionBy("column_id").orderBy("holders", "part").rowsBetween(Window.unboundedPreceding, -1)
    rarest = (
        cells.join(alone, "column_id")
        .withColumn("before", F.col("alone") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where("before < needed")
        .select("column_id", "holders", "part")
    )
    met = member.join(rarest, ["column_id", "holders", "part"]).select(F.col("column_id").alias("small"), "columns").distinct()
    pairs = met.select("small", F.explode("columns").alias("large")).where("small.source <> large.source").distinct()
    small = sizes.select(F.col("column_id").alias("small"), F.col("size").alias("small_size"))
    large = sizes.select(F.col("column_id").alias("large"), F.col("size").alias("large_size"))
    pairs = pairs.join(small, "small").join(large, "large").where("small_size <= large_size").select(
        F.least("small", "large").alias("left"), F.greatest("small", "large").alias("right"), "small_size"
    ).distinct()
    counted = sets.groupBy("columns").agg(F.sum("n").alias("n")).select("columns", "n", F.explode("columns").alias("left"))
    both = counted.join(pairs, "left").where(F.array_contains("columns", F.col("right")))
    return (
        both.groupBy("left", "right", "small_size").agg(F.sum("n").alias("overlap"))
        .where(F.col("overlap") >= least_ratio * F.col("small_size") - 1e-9).select("left", "right", "overlap")
    )


def shared_values(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, value) of every value that both columns of a pair hold; a long table.

    Values that no pair asks for are left out before the join.
    """
    wanted = pairs.select("left", "right").distinct()
    left = values.withColumnRenamed("column_id", "left").join(wanted, "left")
    right = values.withColumnRenamed("column_id", "right").join(wanted.select("right").distinct(), "right", "left_semi")
    return left.join(right, ["right", "value"]).select("left", "right", "value")


def exact_values(columns: DataFrame, sources: DataFrame, counts: ValueCounts) -> DataFrame:
    """Distinct (column_id, value) of the joinable columns, from the value counts."""
    keys = joinable_columns(columns, sources).select(F.struct(F.col("source_position").alias("source"), "position").alias("column_id"))
    return distinct_values(counts).join(keys, "column_id", "left_semi")


def join_candidates(
    columns: DataFrame, sources: DataFrame, counts: ValueCounts | None = None,
    score_names: Callable[[Column, Column], Column] = name_ratio,
) -> DataFrame:
    """Candidate joins with a confidence of at least 0.72.

    With ``counts`` (value counts by source and position) the overlap is exact;
    without, it is that of the twenty smallest values of each column, as kept in
    the profiles.  ``overlap_values`` lists the shared ones of those twenty in
    either mode; :func:`shared_values` has all of an exact overlap.
    """
    eligible = joinable_columns(columns, sources)
    identity = F.struct(F.col("source_position").alias("source"), F.col("position"))
    if counts is None:
        values = eligible.select(identity.alias("column_id"), F.explode("value_sample").alias("value"))
        size = F.size("value_sample").cast("bigint")
    else:
        values = exact_values(columns, sources, counts)
        size = F.col("distinct_count")
    side = eligible.select(
        identity.alias("id"), F.col("normalized"), "inferred_type", size.alias("size"), "value_sample",
        F.struct(*SIDE).alias("side"),
    )

    def named(prefix: str) -> DataFrame:
        return side.select(*[F.col(c).alias(f"{prefix}_{c}") for c in side.columns])

    # What the names and types can add at most; below the rest the overlap alone is too small.
    least_ratio = (fixed.JOIN_KEEP_THRESHOLD - 0.001 - fixed.RATIO_WEIGHT - fixed.SAME_TYPE_BONUS) / fixed.OVERLAP_WEIGHT
    found = (
        likely_overlaps(values, least_ratio)
        .join(named("left"), F.col("left") == F.col("left_id"))
        .join(named("right"), F.col("right") == F.col("right_id"))
    )
    ratio = F.col("overlap") / F.least("left_size", "right_size")
    scored = (
        found.withColumn("_ratio", ratio)
        .withColumn("_names", score_names(F.col("left_normalized"), F.col("right_normalized")))
        .withColumn(
            "confidence_score",
            F.bround(
                F.least(
                    F.col("_ratio") * fixed.OVERLAP_WEIGHT
                    + F.col("_names") * fixed.RATIO_WEIGHT
                    + F.when(F.col("left_inferred_type") == F.col("right_inferred_type"), fixed.SAME_TYPE_BONUS).otherwise(0.0),
                    F.lit(fixed.CONFIDENCE_CEILING),
                ),
                3,
            ),
        )
        .where(F.col("confidence_score") >= fixed.JOIN_KEEP_THRESHOLD)
    )
    return scored.select(
        F.col("left_side").alias("left"), F.col("right_side").alias("right"),
        F.bround("_ratio", 3).alias("overlap_ratio"),
        F.array_sort(F.array_intersect("left_value_sample", "right_value_sample")).alias("overlap_values"),
        "confidence_score",
        F.when(F.col("confidence_score") >= fixed.JOIN_AUTO_THRESHOLD, fixed.AUTO)
        .otherwise(fixed.TO_REVIEW)
        .alias("status"),
    )


def ordered(candidates: DataFrame) -> DataFrame:
    """Best first, then by file names."""
    return candidates.orderBy(
        F.desc("confidence_score"), "left.source_ref", "right.source_ref", "left.column", "right.column"
    )


def shared_key_role(left: Column, right: Column) -> Column:
    """The key role whose names hold both columns."""
    a, b = normalize_key(left), normalize_key(right)
    role = F.lit(None).cast("string")
    for name, _, words in reversed(fixed.KEY_ROLES):
        role = F.when(a.isin(*words) & b.isin(*words), name).otherwise(role)
    return role


def _primary_side(role: Column, left: Column, right: Column) -> Column:
    """'left', 'right' or NULL: which side holds the primary key."""

    def is_anchor(side: Column) -> Column:
        tests = [(role == name) & F.array_contains(side["inferred_entities"], entity) for name, entity, _ in fixed.KEY_ROLES]
        return reduce(Column.__or__, tests)

    reference = F.array(*map(F.lit, fixed.REFERENCE_ENTITIES))
    left_anchor, right_anchor = is_anchor(left), is_anchor(right)
    left_reference = F.arrays_overlap(left["inferred_entities"], reference)
    right_reference = F.arrays_overlap(right["inferred_entities"], reference)
    left_unique = left["uniqueness_ratio"] >= fixed.UNIQUE_THRESHOLD
    right_unique = right["uniqueness_ratio"] >= fixed.UNIQUE_THRESHOLD
    has_role = role.isNotNull()
    return (
        F.when(has_role & left_anchor & ~right_anchor, "left")
        .when(has_role & right_anchor & ~left_anchor, "right")
        .when(has_role & ~left_anchor & ~right_anchor, F.lit(None))
        .when(left_reference & ~right_reference, "left")
        .when(right_reference & ~left_reference, "right")
        .when(left_unique & ~right_unique, "left")
        .when(right_unique & ~left_unique, "right")
    )


def join_rules(candidates: DataFrame) -> DataFrame:
    """Candidates with id, key role, direction, cardinality and status."""
    left, right = F.col("left"), F.col("right")
    roled = candidates.withColumn("_role", shared_key_role(left["column"], right["column"]))
    sided = roled.withColumn("_primary", _primary_side(F.col("_role"), left, right))
    oriented = sided.withColumn(
        "primary", F.when(F.col("_primary") == "left", left).when(F.col("_primary") == "right", right)
    ).withColumn(
        "foreign", F.when(F.col("_primary") == "left", right).when(F.col("_primary") == "right", left)
    )
    directed = F.col("_primary").isNotNull()
    primary_unique = F.col("primary.uniqueness_ratio") >= fixed.UNIQUE_THRESHOLD
    foreign_unique = F.col("foreign.uniqueness_ratio") >= fixed.UNIQUE_THRESHOLD
    return oriented.select(
        stable_id(left["source_ref"], left["column"], right["source_ref"], right["column"]).alias("id"),
        F.coalesce("_role", F.lit("generic_key")).alias("key_role"),
        F.when(directed, "primary_foreign_key").otherwise("peer_key_overlap").alias("join_type"),
        F.when(directed & primary_unique & foreign_unique, "one_to_one")
        .when(directed & primary_unique, "one_to_many")
        .otherwise("many_to_many")
        .alias("cardinality"),
        "left", "right", "primary", "foreign", "overlap_ratio", "overlap_values", "confidence_score",
        F.when(directed & (F.col("status") == fixed.AUTO), fixed.AUTO).otherwise(fixed.TO_REVIEW).alias("status"),
        F.when(directed, "Primary side follows from key role, entities and uniqueness.")
        .otherwise("No side is clearly primary; kept for review.")
        .alias("rationale"),
    )
