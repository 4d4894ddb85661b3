"""Column profiles: type, completeness, distinct, top, first and smallest values.

The data-sized work is one aggregate per cell value (source, column, value).
It is combined before the shuffle, so a value that fills a third of all cells
is one row per task, and a long value goes by a digest.  Everything after it
reads distinct values; the ranked lists use per-partition limits before their own
small shuffle, and only the few long values they keep are read again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.functions.text import normalize, plain_normalize
from harmonia.functions.values import is_code, is_date, is_number, is_year
from harmonia.session import parallel, small_table, written
from harmonia.sources.exports import SourceTable

PROFILE_SCHEMA = (
    "source_ref string, position int, column string, normalized string, inferred_type string, row_count bigint, "
    "completeness double, distinct_count bigint, examples array<string>, "
    "top_values array<struct<value:string,count:bigint>>, value_sample array<string>, sensitivity string"
)


@lru_cache(maxsize=1)
def _whitespace() -> str:
    return "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


def stripped(value: Column) -> Column:
    return F.btrim(value, F.lit(_whitespace()))


# --- expressions on names -----------------------------------------------------------------
def _any_of(words: Iterable[str]) -> str:
    return "|".join(words)


def infer_sensitivity(column: Column, source_ref: Column) -> Column:
    """S4 and S2 by column words, then S3 and S2 by words of source and column, else S1."""
    name = normalize(column)
    context = normalize(F.concat_ws(" ", source_ref, column))
    return (
        F.when(name.rlike(_any_of(fixed.S4_COLUMN_TOKENS)), "S4")
        .when(name.rlike(_any_of(fixed.S2_COLUMN_TOKENS)), "S2")
        .when(context.rlike(_any_of(fixed.S3_CONTEXT_TOKENS)), "S3")
        .when(context.rlike(_any_of(fixed.S2_CONTEXT_TOKENS)), "S2")
        .otherwise("S1")
    )


def infer_entities(source_ref: Column, column_names: Column) -> Column:
    """Entities a source may hold: by file-name word, else by points of hints and aliases.

    ``column_names`` are the normalised column names joined by spaces.
    """
    hints = dict(fixed.FILE_HINTS)

    def holds(name: Column, words: Iterable[str]) -> Column:
        return reduce(Column.__or__, [name.contains(plain_normalize(w)) for w in words])

    def entities_of(named: Column) -> Column:
        file, names = named["file"], named["names"]
        shortcut = F.lit(None).cast("array<string>")
        for word, entities in reversed(fixed.FILE_SHORTCUTS):
            shortcut = F.when(file.contains(word), F.array(*map(F.lit, entities))).otherwise(shortcut)
        scored = []
        for entity in fixed.ENTITIES:
            points = [F.when(holds(file, [h]), fixed.HINT_POINTS).otherwise(0) for h in hints[entity]]
            points += [
                F.when(holds(names, f.aliases), fixed.ALIAS_POINTS).otherwise(0) for f in fixed.TARGET_FIELDS if f.entity == entity
            ]
            total = reduce(Column.__add__, points)
            scored.append(F.struct((-total).alias("order"), F.lit(entity).alias("entity")))
        kept = F.filter(F.array(*scored), lambda s: s["order"] <= -fixed.ENTITY_MIN_POINTS)
        return F.coalesce(shortcut, F.transform(F.array_sort(kept), lambda s: s["entity"]))

    # Bound once as the variable of a function: named by each of the words, the folding would be computed for every one.
    named = F.struct(normalize(source_ref).alias("file"), column_names.alias("names"))
    return F.element_at(F.transform(F.array(named), entities_of), 1)


def infer_type(
    normalized: Column, present: Column, distinct: Column, distinct_normalized: Column, tests: dict[str, Column]
) -> Column:
    """The first rule that holds; ``tests`` say whether all present values pass."""

    def most_differ(share: float) -> Column:
        return distinct >= F.greatest(F.lit(1), F.floor(present * F.lit(share)))

    some = present > 0
    return (
        F.when(normalized.isin("clepers", "cleadh", "site"), "identifier")
        .when(normalized.startswith("cle") & most_differ(0.6), "identifier")
        .when(normalized.rlike("date|debut|fin"), "date")
        .when(normalized.contains("id") & most_differ(0.7), "identifier")
        .when(some & tests["year"], "year")
        .when(some & tests["date"], "date")
        .when(some & tests["number"], "numeric")
        .when(some & tests["code"], "code")
        .when(distinct_normalized <= F.greatest(F.lit(8), F.floor(present * F.lit(0.6))), "categorical")
        .otherwise("text")
    )


# --- cells ----------------------------------------------------------------------------------------
# Longer values are grouped by their first HEAD characters and a digest; their text stays in the source.
HEAD = 64

FILLED, YEAR, DATE, NUMBER, CODE, BOOLEAN = (1 << k for k in range(6))
TESTS = {"year": YEAR, "date": DATE, "number": NUMBER, "code": CODE}


def cells(tables: Iterable[SourceTable]) -> DataFrame:
    """Long form of sources: (source, position, value, ordinal)."""
    parts = []
    for index, table in enumerate(tables):
        names = [f"c_{i}" for i in range(len(table.columns))]
        if names:
            parts.append(
                parallel(table.df).select(F.lit(index).alias("source"), F.posexplode(F.array(*names)).alias("position", "value"), "ordinal")
            )
    return reduce(DataFrame.unionByName, parts)


def _is_long(value: Column) -> Column:
    return F.length(value) > HEAD


def _digest(value: Column) -> Column:
    return F.unhex(F.md5(value))


def _flags(value: Column, bare: Column, normalized: Column) -> Column:
    """What holds for a value, as bits."""
    tests = [
        (bare != "", FILLED), (is_year(bare), YEAR), (is_date(bare), DATE), (is_number(bare), NUMBER), (is_code(bare), CODE),
        ((value == "") | normalized.isin(fixed.BOOLEAN_LIKE), BOOLEAN),
    ]
    return reduce(Column.__add__, [F.when(test, bit).otherwise(0) for test, bit in tests])


def _key(value: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def _facts(value: Column) -> list[Column]:
    bare, normalized = stripped(value), normalize(value)
    found = [_flags(value, bare, normalized), *_key(bare), *_key(normalized)]
    return [x.alias(n) for x, n in zip(found, ("flags", "bare_hi", "bare_lo", "norm_hi", "norm_lo"), strict=True)]


@dataclass(frozen=True)
class ValueCounts:
    """Distinct values of every column of some sources.

    ``rows``: source, position, value, digest, n, first_ordinal.  Of a long value
    ``value`` is the head; its text is read from ``long_cells`` (source, position,
    ordinal, value), a scan of the sources.
    """

    rows: DataFrame
    long_cells: DataFrame
    # Written rows know whether any value is long; else the sources are not read again.
    some_long: bool = True

    def written(self) -> ValueCounts:
        """The rows written once, for the several steps that read them."""
        return self.stored(written(self.rows))

    def stored(self, rows: DataFrame) -> ValueCounts:
        """These counts with their rows as a table that holds them."""
        return ValueCounts(rows, self.long_cells, not rows.where("digest IS NOT NULL").isEmpty())

    def facts(self) -> DataFrame:
        """(source, position, value, n) with flags, and keys of the bare and of the normalised text.

        Those of long values are computed where the cells are read.
        """
        place = ["source", "position", "digest"]
        short = self.rows.where("digest IS NULL").select("source", "position", "value", "n", *_facts(F.col("value")))
        if not self.some_long:
            return short
        cells = self.long_cells.select("source", "position", _digest(F.col("value")).alias("digest"), *_facts(F.col("value")))
        known = cells.groupBy(*place).agg(*(F.max(c).alias(c) for c in cells.columns if c not in place))
        long = self.rows.where("digest IS NOT NULL").select(*place, "value", "n").join(known, place).drop("digest")
        return short.unionByName(long)

    def restored(self, rows: DataFrame | None = None) -> DataFrame:
        """``rows`` (all by default) with the whole text of long values, read where each first stands."""
        rows = self.rows if rows is None else rows
        if not self.some_long:
            return rows.drop("digest")
        place = [F.col("c.source") == F.col("r.source"), F.col("c.position") == F.col("r.position"), F.col("c.ordinal") == F.col("r.first_ordinal")]
        held = [c for c in rows.columns if c != "digest"]
        long = rows.where("digest IS NOT NULL").alias("r").join(self.long_cells.alias("c"), reduce(Column.__and__, place))
        whole = long.select(*(F.col("c.value" if c == "value" else f"r.{c}") for c in held))
        return rows.where("digest IS NULL").select(*held).unionByName(whole)


def value_counts(tables: Iterable[SourceTable]) -> ValueCounts:
    """Per source, column and value: number of cells and the first row that has it.

    No long text is shuffled: its head and a digest stand for it.
    """
    every = cells(list(tables))
    rows = marked(every).groupBy("source", "position", "value", "digest").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_ordinal"))
    return ValueCounts(rows, every.where(_is_long(F.col("value"))))


def marked(every: DataFrame) -> DataFrame:
    """Cells with the head and digest of long values: source, position, ordinal, value, digest."""
    value = F.col("value")
    long = _is_long(value)
    return every.select(
        "source", "position", "ordinal", F.when(long, F.substring(value, 1, HEAD)).otherwise(value).alias("value"),
        F.when(long, _digest(value)).alias("digest"),
    )


def ranked_values(rows: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """The first ``limit`` non-empty values of every column in the given order."""
    window = Window.partitionBy("source", "position").orderBy(*order)
    return rows.where(F.col("value") != "").withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


# Values that one row number holds, where it is not unique: by their text; long ones with one head by their digest.
TIES = ("value", "digest")


def top_values(counts: ValueCounts, limit: int = fixed.TOP_VALUES_LIMIT) -> DataFrame:
    return counts.restored(ranked_values(counts.rows, [F.desc("n"), F.asc("first_ordinal"), *TIES], limit))


def first_examples(counts: ValueCounts, limit: int = fixed.EXAMPLES_LIMIT) -> DataFrame:
    return counts.restored(ranked_values(counts.rows, [F.asc("first_ordinal"), *TIES], limit))


def value_sample(counts: ValueCounts, limit: int = fixed.VALUE_SAMPLE_LIMIT) -> DataFrame:
    """The smallest values.  Texts are read of those whose heads are among the smallest, then they are compared."""
    by_head = Window.partitionBy("source", "position").orderBy("value")
    near = counts.rows.where(F.col("value") != "").withColumn("_near", F.rank().over(by_head)).where(F.col("_near") <= limit)
    return ranked_values(counts.restored(near).drop("_near"), [F.asc("value")], limit)


def column_statistics(counts: ValueCounts) -> DataFrame:
    """One row per column from its value counts."""
    filled = F.col("flags").bitwiseAND(FILLED) != 0

    def all_present(bit: int) -> Column:
        return F.coalesce(F.bool_and(F.when(filled, F.col("flags").bitwiseAND(bit) != 0)), F.lit(True))

    def distinct(name: str) -> Column:
        return F.count_distinct(F.when(filled, F.col(f"{name}_hi")), F.when(filled, F.col(f"{name}_lo")))

    return counts.facts().groupBy("source", "position").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("present"),
        F.count(F.when(F.col("value") != "", F.lit(1))).alias("distinct_count"),
        distinct("bare").alias("distinct_bare"),
        distinct("norm").alias("distinct_normalized"),
        *(all_present(bit).alias(f"all_{name}") for name, bit in TESTS.items()),
    )


# --- profiles ---------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Profiles:
    """``columns`` has a row per column, ``sources`` a row per source."""

    columns: DataFrame
    sources: DataFrame

    def written(self) -> Profiles:
        return Profiles(written(self.columns), written(self.sources))


def profile(spark: SparkSession, tables: Iterable[SourceTable], counts: ValueCounts | None = None) -> Profiles:
    """Profile every column of every source; ``counts`` are their value counts, if already written.

    The counts and the profiles of the columns are written here, since each is read by several steps.
    """
    tables = list(tables)
    listed = [
        (i, t.source_ref, t.format, t.sheet, position, name)
        for i, t in enumerate(tables)
        for position, name in enumerate(t.columns)
    ]
    heads = small_table(
        spark, [(i, t.source_ref, t.format, t.sheet) for i, t in enumerate(tables)],
        "source int, source_ref string, format string, sheet string",
    )
    if not listed:
        columns = spark.createDataFrame([], PROFILE_SCHEMA)
    else:
        names = small_table(
            spark, [(i, ref, position, name) for i, ref, _, _, position, name in listed],
            "source int, source_ref string, position int, column string",
        )
        columns = written(column_profiles(value_counts(tables).written() if counts is None else counts, names))
    per_source = columns.groupBy("source_ref").agg(
        F.max("row_count").alias("row_count"),
        F.concat_ws(
            " ", F.transform(F.array_sort(F.collect_list(F.struct("position", "normalized"))), lambda c: c["normalized"])
        ).alias("column_names"),
    )
    sources = (
        heads.join(per_source, "source_ref", "left")
        .select(
            F.col("source").alias("source_position"), "source_ref", "format", "sheet",
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
            F.when(F.col("row_count").isNull(), F.array().cast("array<string>"))
            .otherwise(infer_entities(F.col("source_ref"), F.coalesce("column_names", F.lit(""))))
            .alias("inferred_entities"),
        )
    )
    return Profiles(columns, sources)


def column_profiles(counts: ValueCounts, names: DataFrame) -> DataFrame:
    """Profiles from value counts; ``names`` gives source_ref and column name of each column."""
    ranked = [
        df.select("source", "position", F.lit(kind).alias("kind"), F.struct("rank", "value", F.col("n").alias("count")).alias("item"))
        for kind, df in (("top", top_values(counts)), ("first", first_examples(counts)), ("sample", value_sample(counts)))
    ]
    lists = reduce(DataFrame.unionByName, ranked).groupBy("source", "position").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("item")))).alias(kind)
            for kind in ("top", "first", "sample")
        ]
    )

    def values_of(kind: str) -> Column:
        return F.coalesce(F.transform(kind, lambda item: item["value"]), F.array().cast("array<string>"))

    joined = column_statistics(counts).join(names, ["source", "position"]).join(lists, ["source", "position"], "left")
    normalized = normalize(F.col("column"))
    return joined.select(
        "source_ref", "position", "column",
        normalized.alias("normalized"),
        infer_type(
            normalized, F.col("present"), F.col("distinct_bare"), F.col("distinct_normalized"),
            {k: F.col(f"all_{k}") for k in ("year", "date", "number", "code")},
        ).alias("inferred_type"),
        "row_count",
        F.bround(F.col("present") / F.greatest(F.col("row_count"), F.lit(1)), 3).alias("completeness"),
        "distinct_count",
        values_of("first").alias("examples"),
        F.coalesce(
            F.transform("top", lambda item: F.struct(item["value"].alias("value"), item["count"].alias("count"))),
            F.array().cast("array<struct<value:string,count:bigint>>"),
        ).alias("top_values"),
        values_of("sample").alias("value_sample"),
        infer_sensitivity(F.col("column"), F.col("source_ref")).alias("sensitivity"),
    )
