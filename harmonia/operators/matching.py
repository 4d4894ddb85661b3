"""Source columns to target fields, and source values to concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.functions.matching import best_alias_score, type_score, value_evidence
from harmonia.functions.text import plain_normalize
from harmonia.functions.values import apply_transform_column, value_mapping_status, values_are_boolean_like
from harmonia.operators.profiling import BOOLEAN, ValueCounts
from harmonia.session import small_table

PROPOSAL_KEY = ("source_ref", "source_column", "entity", "target_field")


def target_fields(spark: SparkSession) -> DataFrame:
    """The target model as a table; its size is fixed."""
    return small_table(
        spark,
        [
            (ord_, f.entity, f.field, f.type, f.sensitivity, f.transform, list(dict.fromkeys(map(plain_normalize, f.aliases))))
            for ord_, f in enumerate(fixed.TARGET_FIELDS)
        ],
        "ord int, entity string, target_field string, target_type string, target_sensitivity string, "
        "transform string, aliases array<string>",
    )


def field_scores(columns: DataFrame, sources: DataFrame, score_name=best_alias_score) -> DataFrame:
    """Every non-S4 column against every field of the entities its source may hold."""
    context = sources.select("source_ref", "source_position", "inferred_entities")
    pairs = (
        columns.where(F.col("sensitivity") != "S4")
        .join(context, "source_ref")
        .withColumn("entity", F.explode("inferred_entities"))
        .join(target_fields(columns.sparkSession), "entity")
    )
    scored = pairs.select(
        "*",
        score_name(F.col("normalized"), F.col("aliases")).alias("name_score"),
        type_score(F.col("inferred_type"), F.col("target_type")).alias("type_score"),
        value_evidence(F.col("examples"), F.col("inferred_type"), F.col("target_field")).alias("value_score"),
    )
    confidence = F.bround(
        F.col("name_score") * fixed.NAME_WEIGHT
        + F.col("type_score") * fixed.TYPE_WEIGHT
        + F.col("value_score") * fixed.VALUE_WEIGHT,
        3,
    )
    return scored.withColumn("confidence_score", confidence).where(F.col("confidence_score") > fixed.DISCARD_THRESHOLD)


def boolean_columns(counts: ValueCounts) -> DataFrame:
    """Whether every value of a column reads as yes or no: (source_position, position, all_boolean)."""
    return counts.facts().groupBy(F.col("source").alias("source_position"), "position").agg(
        F.bool_and(F.col("flags").bitwiseAND(BOOLEAN) != 0).alias("all_boolean")
    )


def propose_mappings(
    columns: DataFrame, sources: DataFrame, score_name=best_alias_score, counts: ValueCounts | None = None
) -> DataFrame:
    """The best field per column and entity, then the best column per source, entity and field.

    A flag whose values are not all yes or no needs review: of all values with
    ``counts``, else of those that the profile keeps.
    """
    capped = field_scores(columns, sources, score_name).withColumn(
        "confidence_score", F.least("confidence_score", F.lit(fixed.CONFIDENCE_CEILING))
    )
    per_column = Window.partitionBy("source_ref", "position", "entity").orderBy(F.desc("confidence_score"), "ord")
    best = capped.withColumn("_rank", F.row_number().over(per_column)).where("_rank = 1")
    if counts is None:
        all_boolean = values_are_boolean_like(F.transform("top_values", lambda v: v["value"]))
    else:
        best = best.join(boolean_columns(counts), ["source_position", "position"], "left")
        all_boolean = F.coalesce("all_boolean", F.lit(True))
    unclear_flag = F.col("target_field").isin("restriction_flag", "amenagement_flag") & ~all_boolean
    status = (
        F.when(F.col("confidence_score") < fixed.REVIEW_THRESHOLD, "ignored")
        .when((F.col("confidence_score") < fixed.AUTO_THRESHOLD) | unclear_flag, fixed.TO_REVIEW)
        .otherwise(fixed.AUTO)
    )
    per_field = Window.partitionBy("source_ref", "entity", "target_field").orderBy(F.desc("confidence_score"), "position")
    return (
        best.withColumn("status", status)
        .where(F.col("status") != "ignored")
        .withColumn("_rank", F.row_number().over(per_field))
        .where("_rank = 1")
        .select(
            "source_ref", F.col("column").alias("source_column"), F.col("inferred_type").alias("source_type"),
            F.col("sensitivity").alias("source_sensitivity"), "entity", "target_field", "target_sensitivity",
            "transform", "confidence_score", "status",
            F.format_string("name=%.2f, type=%.2f, values=%.2f", "name_score", "type_score", "value_score").alias("justification"),
            "examples",
        )
    )


def blocked_columns(columns: DataFrame) -> DataFrame:
    """S4 columns: they reach neither the scoring nor a table."""
    return columns.where(F.col("sensitivity") == "S4").select(
        "source_ref", F.col("column").alias("source_column"), "sensitivity",
        F.lit("direct identifier, sensitive free text or directly identifying company field").alias("reason"),
        F.lit("exclude").alias("recommended_action"),
    )


# --- choice of the source of an entity ------------------------------------------------------
def entity_sources(proposals: DataFrame) -> DataFrame:
    """Sources of each entity, ranked: required fields count five, every field one, plus the confidences."""
    required = F.lit(None).cast("array<string>")
    for entity, names in fixed.REQUIRED_FIELDS.items():
        required = F.when(F.col("entity") == entity, F.array(*map(F.lit, names))).otherwise(required)
    grouped = (
        proposals.where(F.col("status").isin(*fixed.AUTO_STATUSES))
        .groupBy("entity", "source_ref")
        .agg(F.collect_set("target_field").alias("_fields"), F.sum("confidence_score").alias("_confidence"))
        .withColumn("required_count", F.size(F.array_intersect("_fields", F.coalesce(required, F.array().cast("array<string>")))))
        .withColumn("field_count", F.size("_fields"))
        .withColumn("score", F.bround(F.col("required_count") * 5.0 + F.col("field_count") + F.col("_confidence"), 3))
    )
    ranking = Window.partitionBy("entity").orderBy(F.desc("score"), "source_ref")
    return grouped.select(
        "entity", "source_ref", "score", "required_count", "field_count", F.row_number().over(ranking).alias("rank"),
        F.when(F.row_number().over(ranking) == 1, "selected").otherwise("not_selected").alias("status"),
    )


# --- value mappings ---------------------------------------------------------------------------
VALUE_GROUP = ("source_ref", "source_column", "entity", "target_field", "transform")


def value_groups(mapped: DataFrame) -> DataFrame:
    """Mapped columns whose transform maps values to concepts."""
    return mapped.where(F.col("transform").isin(*fixed.VALUE_TRANSFORMS)).select(*VALUE_GROUP)


def value_items(groups: DataFrame, columns: DataFrame, counts: ValueCounts | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Concept and status of each value of the mapped columns, the most frequent first.

    With ``counts`` (value counts by source and position, and the ``sources``
    that number them) every value has its item; without, those that the profile
    keeps.
    """
    key = ["source_ref", "source_column"]
    if counts is None:
        profiled = columns.select("source_ref", F.col("column").alias("source_column"), "top_values")
        items = groups.join(profiled, key).select(*VALUE_GROUP, F.posexplode("top_values").alias("rank", "_item"))
        found = items.select(*VALUE_GROUP, "rank", F.col("_item.value").alias("source_value"), F.col("_item.count").alias("count"))
        return map_values(found)
    named = columns.select("source_ref", F.col("column").alias("source_column"), "position").join(
        sources.select("source_ref", F.col("source_position").alias("source")), "source_ref"
    )
    wanted = named.join(groups.select(*key).distinct(), key, "left_semi")
    values = counts.restored(counts.rows.where("value <> ''").join(wanted, ["source", "position"]))
    place = Window.partitionBy("source", "position").orderBy(F.desc("n"), "first_ordinal")
    ranked = values.select(
        *key, (F.row_number().over(place) - 1).alias("rank"), F.col("value").alias("source_value"), F.col("n").alias("count")
    )
    return map_values(groups.join(ranked, key).select(*VALUE_GROUP, "rank", "source_value", "count"))


def map_values(items: DataFrame) -> DataFrame:
    """Adds ``target_value`` and ``status`` to rows of (transform, source_value)."""
    transform, source = F.col("transform"), F.col("source_value")
    return items.withColumn("target_value", apply_transform_column(transform, source)).withColumn(
        "status", value_mapping_status(transform, source, F.col("target_value"))
    )


def group_status(groups: DataFrame, items: DataFrame, settled: str = "auto_draft") -> DataFrame:
    """Groups with ``a_revoir`` where any value is pending, else ``settled``."""
    pending = items.groupBy(*VALUE_GROUP).agg(F.bool_or(F.col("status") == fixed.TO_REVIEW).alias("_pending"))
    return groups.join(pending, list(VALUE_GROUP), "left").select(
        *VALUE_GROUP,
        F.when(F.col("_pending"), fixed.TO_REVIEW).otherwise(settled).alias("review_status"),
    )
