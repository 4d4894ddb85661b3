"""Matching, source choice, review and registry over catalogues derived from the given tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.functions import text
from harmonia.functions.keys import stable_id
from harmonia.functions.matching import best_alias_score, levenshtein_score
from harmonia.operators import matching, profiling, registry, review
from harmonia.session import cut_lineage, ensure_checkpoint_dir
from suite import query
from suite.profiles import source
from suite.sqltext import norm
from suite.views import read

# --- choice of sources ------------------------------------------------------------------
PROPOSALS_SQL = """
SELECT lang AS entity, source AS source_ref, 'field_' || (n_chars % 7) AS target_field,
       max(round_even(0.5 + (n_chars % 400) / 1000.0, 3)) AS confidence_score
FROM documents GROUP BY 1, 2, 3"""


def document_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as entities, document sources as exports."""
    return (
        read(spark, sf_dir, "documents")
        .groupBy(
            F.col("lang").alias("entity"), F.col("source").alias("source_ref"),
            F.concat(F.lit("field_"), F.col("n_chars") % 7).alias("target_field"),
        )
        .agg(F.max(F.bround(F.lit(0.5) + (F.col("n_chars") % 400) / 1000.0, 3)).alias("confidence_score"))
        .withColumn("status", F.lit("auto_validable"))
    )


@query(
    "source_selection",
    f"""
WITH p AS ({PROPOSALS_SQL}),
g AS (SELECT entity, source_ref, count(*) AS field_count,
             CAST(round_even(CAST(count(*) + sum(CAST(confidence_score AS DECIMAL(12, 3))) AS DOUBLE), 3) AS DOUBLE) AS score
      FROM p GROUP BY 1, 2)
SELECT entity, source_ref, CAST(field_count AS INT) AS field_count, CAST(0 AS INT) AS required_count, score,
       row_number() OVER (PARTITION BY entity ORDER BY score DESC, source_ref) AS rank FROM g
""",
)
def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.entity_sources(document_proposals(spark, sf_dir)).drop("status")


# --- names against names ---------------------------------------------------------------------
ALIASES = ["smallring", "red", "blue widget", "green"]


@query(
    "name_scores_edit_distance",
    f"""
WITH a AS (SELECT unnest(['smallring', 'red', 'bluewidget', 'green']) AS alias),
n AS (SELECT p_partkey, {norm('p_name')} AS n FROM part)
SELECT p_partkey, round(max(CASE WHEN n = alias THEN 1.0 WHEN contains(alias, n) OR contains(n, alias) THEN 0.92
       ELSE 1.0 - levenshtein(n, alias) / CAST(greatest(length(n), length(alias)) AS DOUBLE) END), 6) AS score
FROM n, a GROUP BY 1
""",
)
def name_scores_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harmonia.functions.text import normalize, plain_normalize

    aliases = F.array(*[F.lit(plain_normalize(a)) for a in ALIASES])
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.round(levenshtein_score(normalize(F.col("p_name")), aliases), 6).alias("score")
    )


@query("name_scores_ratio")
def name_scores_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of every distinct part name with the aliases; the names, not the parts, go to Python."""
    from harmonia.functions.text import normalize, plain_normalize

    aliases = F.array(*[F.lit(plain_normalize(a)) for a in ALIASES])
    names = read(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("parts"))
    return names.select("p_name", "parts", F.round(best_alias_score(normalize(F.col("p_name")), aliases), 6).alias("score"))


# --- review ---------------------------------------------------------------------------------------
# Values: brands and types of parts.  Earlier results and decisions come from sizes and prices.
ITEMS_SQL = """
SELECT 'part' AS source_ref, p_brand AS source_column, p_type AS source_value, count(*) AS count,
       CASE WHEN min(p_size) <= 1 THEN 'a_revoir' ELSE 'auto' END AS status FROM part GROUP BY 2, 3"""


def value_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(
        F.count("*").alias("count"), F.min("p_size").alias("smallest")
    )
    return parts.select(
        F.lit("part").alias("source_ref"), F.col("p_brand").alias("source_column"), F.lit("visite_sante_travail").alias("entity"),
        F.lit("type_visite_concept_id").alias("target_field"), F.lit("normalize_visit_type").alias("transform"),
        F.lit(0).alias("rank"), F.col("p_type").alias("source_value"), F.col("p_type").alias("target_value"), "count",
        F.when(F.col("smallest") <= 1, "a_revoir").otherwise("auto").alias("status"),
        F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("review_reason"),
    )


@query(
    "value_items",
    """
WITH c AS (SELECT p_type AS v, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1
           UNION ALL SELECT p_name, count(*), min(p_partkey) FROM part GROUP BY 1)
SELECT v AS source_value, n AS count, trim(upper(regexp_replace(v, '[^A-Za-z0-9]+', '_', 'g')), '_') AS concept FROM c
""",
)
def all_value_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of two mapped columns, however rare, has its item."""
    table = source(spark, sf_dir, "part")
    counts = profiling.value_counts([table]).written()
    profiles = profiling.profile(spark, [table], counts)
    groups = spark.createDataFrame(
        [("part", c, "visite_sante_travail", "type_visite_concept_id", "normalize_visit_type") for c in ("p_type", "p_name")],
        "source_ref string, source_column string, entity string, target_field string, transform string",
    )
    items = matching.value_items(groups, cut_lineage(profiles.columns), counts, profiles.sources)
    return items.select("source_value", "count", text.normalize_upper(F.col("source_value")).alias("concept"))


@query(
    "review_values",
    f"""
WITH i AS ({ITEMS_SQL}),
d AS (SELECT p_brand, p_type, max(p_partkey) AS position,
             arg_max(CASE p_size % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'correct' WHEN 2 THEN 'reject' ELSE 'later' END, p_partkey)
               FILTER (p_size % 4 < 3) AS action,
             arg_max(CASE WHEN p_size % 4 = 1 THEN 'CORRECTED_' || p_size ELSE '' END, p_partkey) FILTER (p_size % 4 < 3) AS target
      FROM part GROUP BY 1, 2)
SELECT i.source_column, i.source_value, i.count,
       CASE WHEN action IN ('approve', 'correct') AND target <> '' THEN target ELSE i.source_value END AS target_value,
       CASE WHEN action IN ('approve', 'correct') THEN 'validated_by_human_review' WHEN action = 'reject' THEN 'rejected'
            ELSE i.status END AS status
FROM i LEFT JOIN d ON d.p_brand = i.source_column AND d.p_type = i.source_value
""",
)
def review_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.col("p_size") % 4
    decisions = read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("bigint").alias("position"), F.lit("").alias("id"),
        F.when(form == 0, "approve").when(form == 1, "correct").when(form == 2, "reject").otherwise("later").alias("action"),
        F.lit("part").alias("source_ref"), F.col("p_brand").alias("source_column"), F.lit("visite_sante_travail").alias("entity"),
        F.lit("type_visite_concept_id").alias("target_field"), F.col("p_type").alias("source_value"),
        F.when(form == 1, F.concat(F.lit("CORRECTED_"), "p_size")).otherwise("").alias("target_value"),
        F.lit("suite").alias("reviewer"), F.lit("").alias("reason"),
    )
    decided = review.decide_values(value_items(spark, sf_dir), decisions)
    return decided.select("source_column", "source_value", "count", "target_value", "status")


@query(
    "review_carry_over",
    f"""
WITH i AS ({ITEMS_SQL}),
e AS (SELECT p_brand, p_type, max(p_name) AS target, CASE WHEN sum(p_size) % 2 = 0 THEN 'rejected' ELSE 'validated_by_human_review' END AS status
      FROM part GROUP BY 1, 2 HAVING count(*) % 3 = 0)
SELECT i.source_column, i.source_value, coalesce(e.target, i.source_value) AS target_value, coalesce(e.status, i.status) AS status
FROM i LEFT JOIN e ON e.p_brand = i.source_column AND e.p_type = i.source_value
""",
)
def review_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = value_items(spark, sf_dir)
    earlier = (
        read(spark, sf_dir, "part").groupBy("p_brand", "p_type")
        .agg(F.max("p_name").alias("target_value"), F.sum("p_size").alias("sizes"), F.count("*").alias("n"))
        .where("n % 3 = 0")
        .select(
            F.lit("part").alias("source_ref"), F.col("p_brand").alias("source_column"), F.lit("visite_sante_travail").alias("entity"),
            F.lit("type_visite_concept_id").alias("target_field"), F.col("p_type").alias("source_value"), "target_value",
            F.when(F.col("sizes") % 2 == 0, "rejected").otherwise("validated_by_human_review").alias("status"),
            F.lit("before").alias("reviewer"), F.lit("").alias("review_reason"),
        )
    )
    return review.carry_over(items, earlier).select("source_column", "source_value", "target_value", "status")


@query(
    "review_join_rules",
    """
WITH d AS (SELECT substr(sha1(CAST(o_custkey AS VARCHAR)), 1, 12) AS id, arg_max(o_orderpriority, o_orderkey) AS last
           FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1)
SELECT c_custkey, CASE WHEN last = '1-URGENT' THEN 'validated_by_human_review' WHEN last = '5-LOW' THEN 'rejected'
                       WHEN c_acctbal > 0 THEN 'auto_validable' ELSE 'a_revoir' END AS status
FROM customer LEFT JOIN d ON d.id = substr(sha1(CAST(c_custkey AS VARCHAR)), 1, 12)
""",
)
def review_join_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rules = read(spark, sf_dir, "customer").select(
        "c_custkey", stable_id(F.col("c_custkey").cast("string")).alias("id"),
        F.when(F.col("c_acctbal") > 0, "auto_validable").otherwise("a_revoir").alias("status"),
        none.alias("reviewer"), none.alias("review_reason"),
    )
    action = F.when(F.col("o_orderpriority") == "1-URGENT", "approve").when(F.col("o_orderpriority") == "5-LOW", "reject").otherwise("wait")
    decisions = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("position"), stable_id(F.col("o_custkey").cast("string")).alias("id"),
        action.alias("action"), F.lit("suite").alias("reviewer"), F.lit("").alias("reason"),
    )
    return review.decide_rules(rules, decisions).select("c_custkey", "status")


@query(
    "review_value_map",
    """
WITH m AS (SELECT p_type, max(p_brand) AS target FROM part GROUP BY 1 HAVING min(p_type) <> 'PROMO')
SELECT p_partkey, coalesce(target, upper(p_type)) AS concept FROM part LEFT JOIN m USING (p_type)
""",
)
def review_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    items = parts.groupBy(F.col("p_type").alias("source_value")).agg(F.max("p_brand").alias("target_value")).withColumn(
        "status", F.when(F.col("source_value") == "PROMO", "a_revoir").otherwise("validated_by_human_review")
    )
    table = parts.select("p_partkey", "p_type", F.upper("p_type").alias("concept"))
    return review.apply_value_map(table, "concept", "p_type", items).select("p_partkey", "concept")


# --- registry ------------------------------------------------------------------------------------------
def entries(parts: DataFrame, stamp: datetime) -> DataFrame:
    """Registry entries keyed by brand and type: one decision per part."""
    grouped = parts.groupBy("p_brand", "p_type").agg(F.count("*").alias("decision_count"), F.max("p_name").alias("last_reason"))
    values = {
        "id": registry.entry_id(F.lit("suite"), F.col("p_brand"), F.col("p_type"), F.lit("f"), F.lit(None).cast("string")),
        "source_system": F.lit("suite"), "source_column": F.col("p_brand"), "entity": F.col("p_type"), "target_field": F.lit("f"),
        "decision_count": F.col("decision_count"), "first_learned_at": F.lit(stamp), "last_learned_at": F.lit(stamp),
        "last_reason": F.col("last_reason"),
    }
    names = [part.split() for part in registry.SCHEMA.split(", ")]
    return grouped.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


REGISTRY_SQL = """
WITH o AS (SELECT p_brand, p_type, count(*) AS n, max(p_name) AS r FROM part WHERE p_partkey % 3 < 2 GROUP BY 1, 2),
l AS (SELECT p_brand, p_type, count(*) AS n, max(p_name) AS r FROM part WHERE p_partkey % 3 > 0 GROUP BY 1, 2)"""


def both_registries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = read(spark, sf_dir, "part")
    return entries(parts.where("p_partkey % 3 < 2"), datetime(2025, 1, 1)), entries(parts.where("p_partkey % 3 > 0"), datetime(2026, 1, 1))


@query(
    "registry_merge",
    REGISTRY_SQL
    + """
SELECT substr(sha1('suite|' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') || '|' || p_type || '|f|'), 1, 12) AS id,
       p_brand AS source_column, p_type AS entity, coalesce(o.n, 0) + coalesce(l.n, 0) AS decision_count,
       CASE WHEN o.n IS NULL THEN 2026 ELSE 2025 END AS first_year, CASE WHEN l.n IS NULL THEN 2025 ELSE 2026 END AS last_year,
       coalesce(l.r, o.r) AS last_reason
FROM o FULL JOIN l USING (p_brand, p_type)
""",
)
def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = registry.merge_entries(*both_registries(spark, sf_dir))
    return merged.select(
        "id", "source_column", "entity", "decision_count", F.year("first_learned_at").alias("first_year"),
        F.year("last_learned_at").alias("last_year"), "last_reason",
    )


@query(
    "registry_apply",
    REGISTRY_SQL
    + """
SELECT p_partkey, CASE WHEN o.n IS NULL THEN 'a_revoir' ELSE 'validated_by_registry' END AS status,
       CASE WHEN o.n IS NULL OR p_size / 50.0 > 0.995 THEN round(p_size / 50.0, 6) ELSE 0.995 END AS confidence_score
FROM part LEFT JOIN o USING (p_brand, p_type)
""",
)
def registry_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _ = both_registries(spark, sf_dir)
    proposals = read(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_brand").alias("source_column"), F.col("p_type").alias("entity"), F.lit("f").alias("target_field"),
        F.lit(None).cast("string").alias("transform"), F.lit("a_revoir").alias("status"),
        (F.col("p_size") / 50.0).alias("confidence_score"), F.lit("size").alias("justification"),
    )
    applied = registry.apply_registry(proposals, known, "suite")
    return applied.select("p_partkey", "status", F.round("confidence_score", 6).alias("confidence_score"))


@query(
    "registry_snapshots",
    """
WITH p AS (SELECT *, p_partkey % 3 AS batch FROM part),
s AS (SELECT unnest([1, 2, 3]) AS snapshot)
SELECT snapshot, p_brand AS source_column, p_type AS entity, count(*) AS decision_count, 2024 + min(batch) AS first_year,
       2024 + max(batch) AS last_year, max(p_name) FILTER (batch = last_batch) AS last_reason
FROM (SELECT s.snapshot, p.*, max(batch) OVER (PARTITION BY s.snapshot, p_brand, p_type) AS last_batch FROM s JOIN p ON p.batch < s.snapshot)
GROUP BY 1, 2, 3
""",
)
def registry_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of decisions, learned one after another, and what each snapshot holds."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    parts = read(spark, sf_dir, "part")
    found = None
    for batch in range(3):
        number = registry.learn(entries(parts.where(F.col("p_partkey") % 3 == batch), datetime(2024 + batch, 1, 1)), folder)
        held = registry.load_registry(spark, folder, number).select(
            F.lit(number).alias("snapshot"), "source_column", "entity", "decision_count", F.year("first_learned_at").alias("first_year"),
            F.year("last_learned_at").alias("last_year"), "last_reason",
        )
        found = held if found is None else found.unionByName(held)
    return found


@query(
    "review_value_map_sources",
    """
WITH reviewed AS (SELECT o_orderpriority AS p, 'P_' || count(*) AS target FROM orders WHERE o_orderpriority < '3' GROUP BY 1)
SELECT o_orderkey, coalesce(target, CASE WHEN o_orderpriority IS NULL THEN 'NONE' ELSE 'RAW' END) AS concept FROM orders LEFT JOIN reviewed ON p = o_orderpriority
""",
)
def review_value_map_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed targets replace the concepts of a table; of several reviews of a value the last source decides."""
    orders = read(spark, sf_dir, "orders")
    counted = orders.groupBy("o_orderpriority").agg(F.concat(F.lit("P_"), F.count("*")).alias("target_value"))
    items = counted.select(
        F.lit("b.csv").alias("source_ref"), F.lit("p").alias("source_column"), F.col("o_orderpriority").alias("source_value"), "target_value",
        F.when(F.col("o_orderpriority") < "3", fixed.BY_HUMAN).otherwise(fixed.TO_REVIEW).alias("status"),
    )
    earlier = items.withColumn("source_ref", F.lit("a.csv")).withColumn("target_value", F.lit("earlier"))
    table = orders.select("o_orderkey", F.lit("RAW").alias("concept"), "o_orderpriority")
    return review.apply_value_map(table, "concept", "o_orderpriority", items.unionByName(earlier)).select("o_orderkey", "concept")
