"""The mapping document: what maps to what, what waits for review, what is blocked.

The document is a set of small DataFrames.  Its fields are bounded by the target
model, the rest by the catalogue of columns.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.functions.keys import stable_id
from harmonia.operators.matching import VALUE_GROUP, entity_sources, group_status, value_groups, value_items
from harmonia.operators.profiling import Profiles, ValueCounts
from harmonia.operators.standard_tables import EntityMap
from harmonia.sources.artifacts import path_exists

TABLES = (
    "entities fields review_queue value_groups value_items join_candidates join_rules blocked alternates sources"
).split()
HEADER_SCHEMA = "mapping_id string, source_system string, schema_version string, mapping_version string, review_status string"


@dataclass(frozen=True)
class Mapping:
    """A mapping document.

    ``entities``: entity, source_ref, review_status.  ``fields``: entity,
    target_field, source_ref, source_column, transform, confidence_score,
    sensitivity, review_status, review_reason.
    """

    source_system: str
    schema_version: str
    mapping_version: str
    review_status: str
    entities: DataFrame
    fields: DataFrame
    review_queue: DataFrame
    value_groups: DataFrame
    value_items: DataFrame
    join_candidates: DataFrame
    join_rules: DataFrame
    blocked: DataFrame
    alternates: DataFrame
    sources: DataFrame

    @property
    def mapping_id(self) -> str:
        return f"{self.source_system.lower()}_{self.schema_version}_draft".replace("-", "_")

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def entity_maps(self) -> dict[str, EntityMap]:
        """Plan-time form: at most one row per field of the target model."""
        mapped: dict[str, dict[str, str]] = {}
        source_of: dict[str, str] = {row["entity"]: row["source_ref"] for row in self.entities.collect()}
        for row in self.fields.collect():
            mapped.setdefault(row["entity"], {})[row["target_field"]] = row["source_column"]
        return {entity: EntityMap(ref, mapped.get(entity, {})) for entity, ref in source_of.items()}

    def save(self, folder: str) -> None:
        for name, df in self.tables().items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        spark = self.fields.sparkSession
        header = [(self.mapping_id, self.source_system, self.schema_version, self.mapping_version, self.review_status)]
        spark.createDataFrame(header, HEADER_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{folder}/header")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Mapping:
        header = spark.read.schema(HEADER_SCHEMA).json(f"{folder}/header").first()
        parts = {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
        return cls(header["source_system"], header["schema_version"], header["mapping_version"], header["review_status"], **parts)

    @staticmethod
    def exists(spark: SparkSession, folder: str) -> bool:
        return path_exists(spark, f"{folder}/header")

    def written(self, folder: str) -> Mapping:
        """Save and read back, so that later steps read tables and not the whole lineage."""
        self.save(folder)
        return Mapping.load(self.fields.sparkSession, folder)


def assemble(
    profiles: Profiles, proposals: DataFrame, blocked: DataFrame, candidates: DataFrame, rules: DataFrame,
    *, source_system: str, schema_version: str, mapping_version: str = "0.1.0-draft", counts: ValueCounts | None = None,
) -> Mapping:
    """The draft document from proposals, blocked columns and the source graph.

    With ``counts`` every value of a mapped column has its item.
    """
    ranked = entity_sources(proposals)
    entities = ranked.where("rank = 1").select("entity", "source_ref", F.lit("auto_draft").alias("review_status"))
    automatic = proposals.where(F.col("status").isin(*fixed.AUTO_STATUSES))
    mapped = automatic.join(entities.select("entity", "source_ref"), ["entity", "source_ref"]).select(
        "entity", "target_field", "source_ref", "source_column", "transform", "confidence_score",
        F.col("target_sensitivity").alias("sensitivity"), F.col("status").alias("review_status"),
        F.lit(None).cast("string").alias("review_reason"),
    )
    groups = value_groups(automatic)
    items = value_items(groups, profiles.columns, counts, profiles.sources)
    return Mapping(
        source_system, schema_version, mapping_version, "draft",
        entities=entities,
        fields=mapped,
        review_queue=proposals.where(F.col("status") == fixed.TO_REVIEW),
        value_groups=group_status(groups, items),
        value_items=with_review_columns(items),
        join_candidates=candidates,
        join_rules=rules.select(
            "*", F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("review_reason")
        ),
        blocked=blocked,
        alternates=ranked.where("rank > 1").drop("rank"),
        sources=profiles.sources,
    )


def with_review_columns(items: DataFrame) -> DataFrame:
    return items.select(
        *VALUE_GROUP, "rank", "source_value", "target_value", "count", "status",
        F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("review_reason"),
    )


@dataclass(frozen=True)
class ReviewQueue:
    """What waits for a human: columns, values (whole groups) and join rules."""

    columns: DataFrame
    values: DataFrame
    rules: DataFrame

    def pending_ids(self) -> DataFrame:
        """(kind, id) of everything pending."""
        return (
            self.columns.select(F.lit("column").alias("kind"), "id")
            .unionByName(self.values.where("suggested_action = 'review'").select(F.lit("value").alias("kind"), "id"))
            .unionByName(self.rules.select(F.lit("rule").alias("kind"), "id"))
        )

    def pending_counts(self) -> DataFrame:
        """Pending items by kind."""
        return self.pending_ids().groupBy("kind").agg(F.count("*").alias("pending"))

    def same_pending(self, other: ReviewQueue) -> bool:
        """Whether both queues wait for the same ids."""
        mine, theirs = self.pending_ids(), other.pending_ids()
        return mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()


def review_queue(mapping: Mapping) -> ReviewQueue:
    pending_groups = mapping.value_groups.where(F.col("review_status") == fixed.TO_REVIEW)
    group_key = list(VALUE_GROUP)
    return ReviewQueue(
        columns=mapping.review_queue.select(
            column_review_id().alias("id"), "source_ref", "source_column", "entity", "target_field", "transform",
            "confidence_score", "examples", F.lit("review").alias("suggested_action"),
        ),
        values=mapping.value_items.join(pending_groups.select(*group_key), group_key, "left_semi").select(
            value_item_id().alias("id"), stable_id(*map(F.col, VALUE_GROUP)).alias("group_id"), *VALUE_GROUP,
            "source_value", "target_value", "count", "status",
            F.when(F.col("status") == fixed.TO_REVIEW, "review").otherwise("none").alias("suggested_action"),
        ),
        rules=mapping.join_rules.where(F.col("status") == fixed.TO_REVIEW).select(
            "id", "key_role", "join_type", "cardinality", "primary", "foreign", "left", "right",
            "confidence_score", "rationale", F.lit("review").alias("suggested_action"),
        ),
    )


def column_review_id():
    return stable_id(F.col("source_ref"), F.col("source_column"), F.col("entity"), F.col("target_field"))


def value_item_id():
    return stable_id(
        F.col("source_ref"), F.col("source_column"), F.col("entity"), F.col("target_field"), F.col("source_value")
    )


def changed(mapping: Mapping, **parts) -> Mapping:
    known = {f.name for f in fields(Mapping)}
    assert set(parts) <= known
    return replace(mapping, **parts)
