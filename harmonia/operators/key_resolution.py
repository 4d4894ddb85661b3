"""Foreign keys resolved through the join rules of the source graph."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.operators.skew import hot_keys, join_unique
from harmonia.sources.exports import SourceTable


def unique_index(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur on exactly one row; the empty key never counts."""
    return _key_counts(df, key).where("n = 1").select(key)


def ambiguous_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur on several rows, which an index leaves out."""
    return _key_counts(df, key).where("n > 1")


def _key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n"))


def usable_rules(rules: DataFrame) -> DataFrame:
    """Rules that may resolve keys: approved, directed, with a unique primary side."""
    return rules.where(
        F.col("status").isin(*fixed.USABLE_RULE_STATUSES)
        & (F.col("join_type") == "primary_foreign_key")
        & F.col("cardinality").isin(*fixed.USABLE_CARDINALITIES)
        & F.col("primary").isNotNull()
        & F.col("foreign").isNotNull()
    )


@dataclass(frozen=True)
class Rule:
    id: str
    key_role: str
    primary_source: str
    primary_column: str
    foreign_source: str
    foreign_column: str
    primary_uniqueness: float
    confidence: float

    @property
    def priority(self) -> tuple[float, float, str]:
        return (-self.primary_uniqueness, -self.confidence, self.id)


@dataclass
class JoinContext:
    """Usable rules by foreign source and role, best first, over the landed sources."""

    sources: Mapping[str, SourceTable]
    rules: list[Rule] = field(default_factory=list)

    @classmethod
    def build(cls, sources: Mapping[str, SourceTable], rules: DataFrame) -> JoinContext:
        """Rules are catalogue metadata: at most one per pair of columns of the catalogue."""
        rows = usable_rules(rules).select(
            "id", "key_role", "primary.source_ref", "primary.column",
            F.col("foreign.source_ref").alias("f_source"), F.col("foreign.column").alias("f_column"),
            F.coalesce("primary.uniqueness_ratio", F.lit(0.0)), F.coalesce("confidence_score", F.lit(0.0)),
        )
        return cls(sources, sorted((Rule(*row) for row in rows.collect()), key=lambda rule: rule.priority))

    def rules_for(self, source_ref: str, key_role: str) -> list[Rule]:
        return [r for r in self.rules if (r.foreign_source, r.key_role) == (source_ref, key_role)]

    def index(self, rule: Rule, key: str) -> DataFrame:
        primary = self.sources[rule.primary_source]
        return unique_index(primary.df.select(primary.cell(rule.primary_column).alias(key)), key)

    def resolve(
        self, frame: DataFrame, table: SourceTable, key_role: str, fallback: str | None, out: str,
        hot: Callable[[DataFrame, str], DataFrame] | None = hot_keys,
    ) -> DataFrame:
        """Adds ``out`` and, where rules exist, ``out_resolved``.

        The first rule whose foreign value is a unique primary key gives the key;
        without any, the fallback column of the row does.  ``frame`` holds the
        cells of ``table``.  Rules with one foreign column are one join, with the
        first of them that knows the key; hot keys come from the column itself,
        so every rule adds one scan of its index and every column one join.
        """
        rules = self.rules_for(table.source_ref, key_role)
        columns = list(dict.fromkeys(rule.foreign_column for rule in rules))
        ranks, cells = [], []
        for i, column in enumerate(columns):
            key, rank = f"_key_{i}", f"_rank_{i}"
            parts = [
                self.index(rule, key).withColumn(rank, F.lit(n)) for n, rule in enumerate(rules) if rule.foreign_column == column
            ]
            known = reduce(DataFrame.unionByName, parts)
            if len(parts) > 1:
                known = known.groupBy(key).agg(F.min(rank).alias(rank))
            cell = table.cell(column)
            frame = frame.withColumn(key, cell)
            if hot is None:
                frame = frame.join(known, key, "left")
            else:
                frame = join_unique(frame, known, key, hot=hot(table.df.select(cell.alias(key)), key))
            ranks.append(F.col(rank))
            cells.append(F.col(key))
        if not rules:
            return frame.withColumn(out, table.cell(fallback))
        best = ranks[0] if len(ranks) == 1 else F.least(*ranks)
        found = F.coalesce(*[F.when(rank == best, cell) for rank, cell in zip(ranks, cells, strict=True)])
        frame = frame.withColumn(out, F.coalesce(found, table.cell(fallback))).withColumn(f"{out}_resolved", best.isNotNull())
        return frame.drop(*[f"_key_{i}" for i in range(len(columns))], *[f"_rank_{i}" for i in range(len(columns))])

    def usage(self, table: SourceTable, key_role: str, condition=None) -> DataFrame | None:
        """(key_role, attempted, resolved, missed) of a table's rows; None without rules.

        Only the key columns are read, and equal keys are counted together
        before the joins.
        """
        rules = self.rules_for(table.source_ref, key_role)
        if not rules:
            return None
        rows = table.df if condition is None else table.df.where(condition)
        keys = sorted({f"c_{table.columns.index(r.foreign_column)}" for r in rules if r.foreign_column in table.columns})
        counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
        resolved = self.resolve(counted, table, key_role, None, "_value", hot=None)
        hits = F.coalesce(F.sum(F.when(F.col("_value_resolved"), F.col("_n"))), F.lit(0))
        total = F.coalesce(F.sum("_n"), F.lit(0))
        return resolved.agg(total.alias("attempted"), hits.alias("resolved"), (total - hits).alias("missed")).select(
            F.lit(key_role).alias("key_role"), "*"
        )

    def index_diagnostics(self) -> DataFrame | None:
        """Primary columns with ambiguous keys: their number and the first five."""
        parts = []
        for source_ref, column in sorted({(r.primary_source, r.primary_column) for r in self.rules}):
            primary = self.sources[source_ref]
            keys = ambiguous_keys(primary.df.select(primary.cell(column).alias("key")), "key")
            smallest = keys.select("key").orderBy("key").limit(5)
            parts.append(
                keys.agg(F.count("*").alias("duplicate_values_count"))
                .select(
                    F.lit(source_ref).alias("source_ref"), F.lit(column).alias("column"), "duplicate_values_count",
                    smallest.agg(F.array_sort(F.collect_list("key"))).scalar().alias("duplicate_values"),
                )
                .where("duplicate_values_count > 0")
            )
        return _union(parts)


def _union(parts: Iterable[DataFrame]) -> DataFrame | None:
    whole = None
    for part in parts:
        whole = part if whole is None else whole.unionByName(part)
    return whole
