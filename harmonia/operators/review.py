"""Human decisions applied to a mapping document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.operators.matching import VALUE_GROUP, group_status, value_groups, value_items
from harmonia.operators.skew import join_unique
from harmonia.operators.profiling import ValueCounts
from harmonia.plans.mapping_document import (
    Mapping,
    changed,
    column_review_id,
    value_item_id,
    with_review_columns,
)

COLUMN_SCHEMA = "position bigint, id string, action string, reviewer string, reason string"
VALUE_SCHEMA = (
    "position bigint, id string, action string, source_ref string, source_column string, entity string, "
    "target_field string, source_value string, target_value string, reviewer string, reason string"
)
RULE_SCHEMA = COLUMN_SCHEMA
VALUE_KEY = ("source_ref", "source_column", "entity", "target_field", "source_value")


@dataclass(frozen=True)
class Decisions:
    """Decisions on columns, values and join rules; ``position`` orders repeated ones."""

    columns: DataFrame
    values: DataFrame
    rules: DataFrame

    @classmethod
    def from_rows(cls, spark: SparkSession, columns=(), values=(), rules=()) -> Decisions:
        """From dictionaries, as a review file holds them."""

        def table(rows, schema: str) -> DataFrame:
            names = [part.split()[0] for part in schema.split(", ")]
            return spark.createDataFrame(
                [tuple([i, *[row.get(n) for n in names[1:]]]) for i, row in enumerate(rows)], schema
            )

        return cls(table(columns, COLUMN_SCHEMA), table(values, VALUE_SCHEMA), table(rules, RULE_SCHEMA))

    def approved_columns(self) -> DataFrame:
        return last_decision(self.columns.where("action = 'approve'"), ["id"])


def last_decision(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """One decision per key: the last one given."""
    rest = [c for c in decisions.columns if c not in keys]
    return decisions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "position").alias("_d")).select(*keys, "_d.*")


def _or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


@dataclass(frozen=True)
class Reviewed:
    mapping: Mapping
    skipped: DataFrame  # approved columns whose entity reads another source


def apply_decisions(
    mapping: Mapping, decisions: Decisions, columns: DataFrame, *, drop_rejected: bool = False,
    counts: ValueCounts | None = None, sources: DataFrame | None = None,
) -> Reviewed:
    """The reviewed document.

    Approved columns become fields (and open their entity where it is new),
    value groups are rebuilt, earlier value reviews are carried over, then value
    and rule decisions apply.  Rejected columns stay pending unless
    ``drop_rejected`` is set.  ``counts`` and ``sources`` are those of
    :func:`~harmonia.operators.matching.value_items`.
    """
    approved = decisions.approved_columns().select("id", "reviewer", "reason")
    queue = mapping.review_queue.withColumn("id", column_review_id())
    accepted = queue.join(approved, "id")

    first_come = Window.partitionBy("entity").orderBy("source_ref", "entity", "target_field")
    opened = (
        accepted.join(mapping.entities.select("entity"), "entity", "left_anti")
        .withColumn("_rank", F.row_number().over(first_come))
        .where("_rank = 1")
        .select("entity", "source_ref", F.lit("reviewed").alias("review_status"))
    )
    entities = mapping.entities.unionByName(opened)
    homes = entities.select("entity", "source_ref")
    added = accepted.join(homes, ["entity", "source_ref"], "left_semi").select(
        "entity", "target_field", "source_ref", "source_column", "transform", "confidence_score",
        F.col("target_sensitivity").alias("sensitivity"), F.lit(fixed.BY_HUMAN).alias("review_status"),
        _or_empty(F.col("reason")).alias("review_reason"),
    )
    skipped = accepted.join(homes, ["entity", "source_ref"], "left_anti").select(
        "id", "source_ref", "source_column", "entity", "target_field"
    )
    all_fields = mapping.fields.join(added, ["entity", "target_field"], "left_anti").unionByName(added)

    leaving = approved.select("id")
    if drop_rejected:
        leaving = leaving.unionByName(decisions.columns.where("action = 'reject'").select("id"))
    remaining = queue.join(leaving, "id", "left_anti").drop("id")

    groups = value_groups(all_fields).join(
        columns.select("source_ref", F.col("column").alias("source_column")), ["source_ref", "source_column"], "left_semi"
    )
    items = with_review_columns(value_items(groups, columns, counts, sources))
    items = carry_over(items, mapping.value_items)
    items = decide_values(items, decisions.values)
    return Reviewed(
        changed(
            mapping,
            entities=entities,
            fields=all_fields,
            review_queue=remaining,
            value_groups=group_status(groups, items, "reviewed"),
            value_items=items,
            join_rules=decide_rules(mapping.join_rules, decisions.rules),
            mapping_version=reviewed_version(mapping.mapping_version),
            review_status="reviewed",
        ),
        skipped,
    )


def carry_over(items: DataFrame, previous: DataFrame) -> DataFrame:
    """Earlier human results on the same values win over the fresh proposal."""
    earlier = previous.where(F.col("status").isin(fixed.BY_HUMAN, fixed.REJECTED)).select(
        *VALUE_KEY,
        F.struct("target_value", "status", "reviewer", "review_reason").alias("_earlier"),
    )
    joined = items.join(earlier, list(VALUE_KEY), "left")
    kept = F.col("_earlier").isNotNull()
    return joined.select(
        *VALUE_GROUP, "rank", "source_value",
        F.when(kept, F.coalesce(F.col("_earlier.target_value"), F.col("target_value"))).otherwise(F.col("target_value")).alias("target_value"),
        "count",
        F.when(kept, F.col("_earlier.status")).otherwise(F.col("status")).alias("status"),
        F.coalesce(F.nullif(F.col("_earlier.reviewer"), F.lit("")), F.col("reviewer")).alias("reviewer"),
        F.coalesce(F.nullif(F.col("_earlier.review_reason"), F.lit("")), F.col("review_reason")).alias("review_reason"),
    )


def decide_values(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approve, correct or reject values; a decision by id goes before one by key."""
    valid = decisions.where(F.col("action").isin("approve", "correct", "reject"))
    outcome = F.struct("action", "target_value", "reviewer", "reason")
    by_id = last_decision(valid.where(_or_empty(F.col("id")) != ""), ["id"]).select(
        F.col("id").alias("_id"), outcome.alias("_by_id")
    )
    keyed = valid.select("position", "action", "target_value", "reviewer", "reason", *[_or_empty(F.col(k)).alias(k) for k in VALUE_KEY])
    by_key = last_decision(keyed, list(VALUE_KEY)).select(*VALUE_KEY, outcome.alias("_by_key"))
    joined = (
        items.withColumn("_id", value_item_id())
        .join(by_id, "_id", "left")
        .join(by_key, list(VALUE_KEY), "left")
        .withColumn("_d", F.coalesce("_by_id", "_by_key"))
    )
    decided = F.col("_d").isNotNull()
    confirmed = F.col("_d.action").isin("approve", "correct")
    return joined.select(
        *VALUE_GROUP, "rank", "source_value",
        F.when(confirmed, F.coalesce(F.nullif(F.col("_d.target_value"), F.lit("")), F.col("target_value")))
        .otherwise(F.col("target_value")).alias("target_value"),
        "count",
        F.when(confirmed, fixed.BY_HUMAN).when(decided, fixed.REJECTED).otherwise(F.col("status")).alias("status"),
        F.when(decided, _or_empty(F.col("_d.reviewer"))).otherwise(F.col("reviewer")).alias("reviewer"),
        F.when(decided, _or_empty(F.col("_d.reason"))).otherwise(F.col("review_reason")).alias("review_reason"),
    )


def decide_rules(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approve or reject join rules by id."""
    valid = decisions.where(F.col("action").isin("approve", "reject") & (_or_empty(F.col("id")) != ""))
    last = last_decision(valid, ["id"]).select(
        "id", F.struct("action", "reviewer", "reason").alias("_d")
    )
    decided = F.col("_d").isNotNull()
    names = [c for c in rules.columns if c not in ("status", "reviewer", "review_reason")]
    return rules.join(last, "id", "left").select(
        *names,
        F.when(F.col("_d.action") == "approve", fixed.BY_HUMAN)
        .when(decided, fixed.REJECTED)
        .otherwise(F.col("status"))
        .alias("status"),
        F.when(decided, _or_empty(F.col("_d.reviewer"))).otherwise(F.col("reviewer")).alias("reviewer"),
        F.when(decided, _or_empty(F.col("_d.reason"))).otherwise(F.col("review_reason")).alias("review_reason"),
    )


def reviewed_version(version: str) -> str:
    return version if version.endswith("-reviewed") else f"{version}-reviewed"


def apply_value_map(df: DataFrame, column: str, raw: str, items: DataFrame) -> DataFrame:
    """Replace concepts by reviewed ones: ``items`` holds source_value and target_value of one field.

    Optional: the standard builders use the fixed transforms.  Values of one
    field are joined on the raw text, with frequent texts kept apart.  Where a
    value has several reviewed targets, that of the last source and column wins.
    """
    place = [F.col(c) for c in ("source_ref", "source_column") if c in items.columns]
    reviewed = items.where(F.col("status") == fixed.BY_HUMAN).groupBy(F.col("source_value").alias(raw)).agg(
        F.max_by("target_value", F.struct(*place, "target_value")).alias("_reviewed")
    )
    joined = join_unique(df.withColumn(raw, _or_empty(F.col(raw))), reviewed, raw)
    return joined.withColumn(column, F.coalesce("_reviewed", column)).drop("_reviewed")
