"""Quality rules: each yields (rule, severity, status, message)."""

from __future__ import annotations

from collections.abc import Mapping as Dict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.functions.values import TRANSFORMS, value_mapping_status
from harmonia.plans.mapping_document import Mapping
from harmonia.session import small_table
from harmonia.sources.exports import SourceTable

BLOCKING, WARNING, INFO = "bloquant", "alerte", "info"


def outcome(rule: Column | str, failed: Column, severity: str, bad: Column, good: Column | str) -> list[Column]:
    """Columns of a rule row: the severity counts only where the rule fails."""
    good = F.lit(good) if isinstance(good, str) else good
    return [
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"),
        F.when(failed, severity).otherwise(INFO).alias("severity"),
        F.when(failed, "failed").otherwise("passed").alias("status"),
        F.when(failed, bad).otherwise(good).alias("message"),
    ]


def required_mappings(mapping: Mapping) -> DataFrame:
    """Required fields that no source column maps to, one row per entity."""
    spark = mapping.fields.sparkSession
    required = small_table(
        spark,
        [(i, e, p, f) for i, (e, names) in enumerate(fixed.REQUIRED_FIELDS.items()) for p, f in enumerate(names)],
        "ord int, entity string, position int, target_field string",
    )
    mapped = mapping.fields.select("entity", "target_field", F.lit(True).alias("_mapped"))
    gaps = required.join(mapped, ["entity", "target_field"], "left").groupBy("entity").agg(
        F.min("ord").alias("ord"),
        F.array_sort(F.collect_list(F.when(F.col("_mapped").isNull(), F.struct("position", "target_field")))).alias("_gaps"),
    )
    missing = F.array_join(F.transform("_gaps", lambda g: g["target_field"]), ", ")
    return gaps.select(
        *outcome(
            F.concat(F.lit("required_mapping:"), "entity"), F.size("_gaps") > 0, BLOCKING,
            F.concat(F.lit("Missing required fields: "), missing), "All required fields are mapped.",
        )
    )


def mapped_source_columns(mapping: Mapping, sources: Dict[str, SourceTable]) -> DataFrame:
    """Mapped columns that their source does not have; an empty source has none."""
    spark = mapping.fields.sparkSession
    existing = small_table(
        spark, [(ref, name) for ref, table in sources.items() for name in table.columns],
        "source_ref string, source_column string",
    )
    filled = mapping.sources.where("row_count > 0").select("source_ref")
    available = existing.join(filled, "source_ref", "left_semi").withColumn("_found", F.lit(True))
    checked = (
        mapping.fields.join(available, ["source_ref", "source_column"], "left")
        .groupBy("entity", "source_ref")
        .agg(F.array_sort(F.collect_list(F.when(F.col("_found").isNull(), F.col("source_column")))).alias("_missing"))
    )
    return checked.select(
        *outcome(
            F.concat(F.lit("mapping_source_columns:"), "entity"), F.size("_missing") > 0, BLOCKING,
            F.concat(F.lit("Source columns missing in "), "source_ref", F.lit(": "), F.array_join("_missing", ", ")),
            F.concat(F.lit("All mapped columns exist in "), "source_ref", F.lit(".")),
        )
    )


def pending_columns(mapping: Mapping) -> DataFrame:
    n = F.col("n")
    return mapping.review_queue.agg(F.count("*").alias("n")).select(
        *outcome("review_queue:pending_mapping_proposals", n > 0, WARNING,
                 F.concat(n, F.lit(" mapping proposals require human review.")),
                 "No column mapping proposal is pending review.")
    )


def pending_values(mapping: Mapping) -> DataFrame:
    """Values that wait for a domain review; the message names the first five."""
    pending = mapping.value_items.where(F.col("status") == fixed.TO_REVIEW)
    label = F.format_string("%s::%s %s->%s", "source_ref", "source_column", "source_value", "target_value")
    shown = (
        pending.select("source_ref", "entity", "target_field", "rank", label.alias("label"))
        .orderBy("source_ref", "entity", "target_field", "rank")
        .limit(5)
        .agg(F.array_sort(F.collect_list(F.struct("source_ref", "entity", "target_field", "rank", "label"))).alias("_s"))
        .select(F.array_join(F.transform("_s", lambda s: s["label"]), ", "))
    )
    n = F.col("n")
    return pending.agg(F.count("*").alias("n")).select("n", shown.scalar().alias("shown")).select(
        *outcome("review_queue:pending_value_mappings", n > 0, WARNING,
                 F.concat(n, F.lit(" nomenclature values require domain review: "), "shown"),
                 "No nomenclature value is pending domain review.")
    )


def candidate_count(mapping: Mapping) -> DataFrame:
    n = F.col("n")
    return mapping.join_candidates.agg(F.count("*").alias("n")).select(
        *outcome("source_graph:join_candidates", n == 0, WARNING,
                 F.lit("No join candidate detected between exports."),
                 F.concat(n, F.lit(" join candidates detected between exports.")))
    )


def pending_rules(mapping: Mapping) -> DataFrame:
    n, waiting = F.col("n"), F.col("waiting")
    made = F.concat(n, F.lit(" explicit join rules generated"))
    return mapping.join_rules.agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == fixed.TO_REVIEW).alias("waiting")
    ).select(
        *outcome("source_graph:explicit_join_rules", waiting > 0, WARNING,
                 F.concat(made, F.lit("; "), waiting, F.lit(" require review.")), F.concat(made, F.lit(".")))
    )


def resolution(usage: DataFrame, ambiguous: DataFrame | None) -> DataFrame:
    """Key look-ups; fails where a primary column has ambiguous keys."""
    indexes = ambiguous.agg(F.count("*")).scalar() if ambiguous is not None else F.lit(0)
    totals = usage.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("attempted", "resolved", "missed")]
    ).select("*", indexes.alias("ambiguous"))
    message = F.concat(
        "resolved", F.lit("/"), "attempted", F.lit(" key values resolved through explicit join rules; "),
        "missed", F.lit(" unresolved; "), "ambiguous", F.lit(" ambiguous primary indexes."),
    )
    return totals.select(*outcome("source_graph:join_resolution", F.col("ambiguous") > 0, WARNING, message, message))


def dangling_rows(facts: DataFrame, key: str, parents: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Number of fact rows (``n``) per key that no parent has.

    Facts are counted per key before the join, so a hot key is one row.
    """
    counted = facts.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"))
    known = parents.select(F.col(parent_key or key).alias("_key")).distinct()
    return counted.join(known, "_key", "left_anti").select(F.col("_key").alias(key), "n")


def worker_coverage(tables: Dict[str, DataFrame]) -> list[DataFrame]:
    """Facts whose worker is not in the worker table."""
    rows = []
    for name in ("visite_sante_travail", "exposition_professionnelle", "episode_poste"):
        if name in tables:
            n = F.col("n")
            unknown = dangling_rows(tables[name], "travailleur_id", tables["travailleur"])
            rows.append(
                unknown.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
                    *outcome(f"join_coverage:{name}.travailleur_id", n > 0, WARNING,
                             F.concat(n, F.lit(" worker ids are missing from table travailleur.")),
                             "All referenced workers exist.")
                )
            )
    return rows


def blocked_fields(mapping: Mapping) -> DataFrame:
    message = F.concat(F.col("n"), F.lit(" S4 fields excluded from the standard tables."))
    return mapping.blocked.agg(F.count("*").alias("n")).select(
        *outcome("sensitivity:S4_blocked", F.lit(False), INFO, message, message)
    )


def quality_rules(
    mapping: Mapping, sources: Dict[str, SourceTable], tables: Dict[str, DataFrame],
    usage: DataFrame, ambiguous: DataFrame | None,
) -> DataFrame:
    """Every rule, in report order (``ord``)."""
    parts = [
        required_mappings(mapping), mapped_source_columns(mapping, sources), pending_columns(mapping),
        pending_values(mapping), candidate_count(mapping), pending_rules(mapping), resolution(usage, ambiguous),
        *worker_coverage(tables), blocked_fields(mapping),
    ]
    return union_rules(parts)


def union_rules(parts: list[DataFrame]) -> DataFrame:
    numbered = [part.select(F.lit(i).alias("ord"), "rule", "severity", "status", "message") for i, part in enumerate(parts)]
    return reduce(DataFrame.unionByName, numbered)


# --- record-level checks ----------------------------------------------------------------------
def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that several rows share, with their number."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def incoherent_dates(df: DataFrame, start: str = "date_debut", end: str = "date_fin") -> DataFrame:
    """Rows that end before they start."""
    return df.where(F.col(end) < F.col(start))


def unknown_values(df: DataFrame, column: str, transform: str) -> DataFrame:
    """Distinct raw values that the transform maps to no known concept, with their rows."""
    source = F.col("source_value")
    # Carried through an aggregate, so that the test runs once per distinct value:
    # a filter on the grouping key itself would be pushed below, to every row.
    return (
        df.groupBy(F.col(column).alias("_key"))
        .agg(F.count("*").alias("n"), F.min(column).alias("source_value"))
        .drop("_key")
        .withColumn("target_value", TRANSFORMS[transform](source))
        .where(value_mapping_status(F.lit(transform), source, F.col("target_value")) == fixed.TO_REVIEW)
    )


def unknown_rate(df: DataFrame, column: str, transform: str) -> DataFrame:
    """Share of rows whose value has no known concept."""
    counted = df.groupBy(F.col(column).alias("source_value")).agg(F.count("*").alias("n"))
    source = F.col("source_value")
    unknown = value_mapping_status(F.lit(transform), source, TRANSFORMS[transform](source)) == fixed.TO_REVIEW
    return counted.agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(unknown, F.col("n"))), F.lit(0)).alias("unknown_rows")
    ).withColumn("unknown_rate", F.bround(F.col("unknown_rows") / F.greatest("rows", F.lit(1)), 4))


def row_loss(sources: Dict[str, DataFrame], tables: Dict[str, DataFrame]) -> DataFrame:
    """Rows of each table against the rows of its source."""
    parts = [
        tables[name].agg(F.count("*").alias("target_rows")).select(
            F.lit(name).alias("table"), sources[name].agg(F.count("*")).scalar().alias("source_rows"), "target_rows"
        )
        for name in tables
        if name in sources
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("lost_rows", F.col("source_rows") - F.col("target_rows"))


def anomalies(tables: Dict[str, DataFrame], keys: Dict[str, str]) -> DataFrame:
    """One row per offending record of the standard tables: (rule, table, record_id, detail).

    Duplicate ids and dates out of order; ``keys`` names the id column of each table.
    """
    parts = []
    for name, df in tables.items():
        key = keys[name]
        repeated = duplicate_keys(df, key)
        parts.append(
            repeated.select(F.lit("duplicate_id").alias("rule"), F.lit(name).alias("table"),
                            F.col(key).cast("string").alias("record_id"), F.concat(F.col("n"), F.lit(" rows")).alias("detail"))
        )
        if {"date_debut", "date_fin"} <= set(df.columns):
            parts.append(
                incoherent_dates(df).select(
                    F.lit("dates_out_of_order").alias("rule"), F.lit(name).alias("table"),
                    F.col(key).cast("string").alias("record_id"),
                    F.concat_ws(" > ", F.col("date_debut").cast("string"), F.col("date_fin").cast("string")).alias("detail"),
                )
            )
    return reduce(DataFrame.unionByName, parts)
