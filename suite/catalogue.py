"""The given tables under the names of exports: profiles, matching and source graph as the engine infers them.

Names are compared by edit distance here, which SQL can say too.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.functions.matching import edit_ratio, levenshtein_score
from harmonia.functions.text import plain_normalize
from harmonia.operators import matching, profiling, quality, source_graph
from harmonia.plans.mapping_document import Mapping, assemble
from harmonia.session import cut_lineage, ensure_checkpoint_dir
from harmonia.sources.exports import SourceTable
from suite import query
from suite.scalars import entity_sql
from suite.sqltext import norm
from suite.views import read

# Export, its table, (header, expression in Spark and SQL) of its columns, and the row order.
EXPORTS = {
    "salaries.csv": (
        "customer",
        [("id_salarie", "c_custkey"), ("site", "c_nationkey"), ("annee_naissance", "1950 + c_nationkey"),
         ("genre", "CASE WHEN c_acctbal < 0 THEN 'F' ELSE 'M' END"), ("suivi", "c_mktsegment"), ("nom", "c_name")],
        "c_custkey",
    ),
    "visites.csv": (
        "orders",
        [("clepers", "o_custkey"), ("site", "o_orderkey % 40"), ("nature_visite", "o_orderpriority"),
         ("restriction_txt", "CASE WHEN o_orderstatus = 'F' THEN 'oui' ELSE 'non' END"), ("adaptation", "o_orderstatus"),
         ("avis", "CASE WHEN o_totalprice < 1000 THEN 'apte' ELSE 'inapte' END")],
        "o_orderkey",
    ),
    "expositions.csv": (
        "events",
        [("matricule", "user_id"), ("nuisance", "event_type"), ("intensite", "CASE WHEN value < 10 THEN 'faible' ELSE 'forte' END")],
        "event_id",
    ),
    "structures.csv": (
        "nation", [("site", "n_nationkey"), ("territoire", "n_regionkey"), ("raison_sociale", "n_name")], "n_nationkey",
    ),
}


def exports(spark: SparkSession, sf_dir: str) -> list[SourceTable]:
    tables = []
    for ref, (table, columns, order) in EXPORTS.items():
        df = read(spark, sf_dir, table).select(*[F.expr(e).alias(n) for n, e in columns], F.expr(order).alias("row_number"))
        made = SourceTable.from_dataframe(ref, df, F.col("row_number") + 1)
        tables.append(
            SourceTable(ref, tuple(n for n, _ in columns), made.df.drop(f"c_{len(columns)}"), made.format)
        )
    return tables


def profiled(spark: SparkSession, sf_dir: str) -> tuple[profiling.Profiles, profiling.ValueCounts]:
    tables = exports(spark, sf_dir)
    # Written between the stages, as the workflow does: both are read several times.
    counts = profiling.value_counts(tables).written()
    return profiling.profile(spark, tables, counts).written(), counts


# --- SQL --------------------------------------------------------------------------------------------
def double(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def words(tokens: list[str]) -> str:
    return "|".join(tokens)


CELLS = " UNION ALL ".join(
    f"SELECT {s} AS source, {p} AS position, CAST({e} AS VARCHAR) AS value, {order} AS ordinal FROM {table}"
    for s, (table, columns, order) in enumerate(EXPORTS.values())
    for p, (_, e) in enumerate(columns)
)
NAMES = ", ".join(
    f"({s}, {p}, '{ref}', '{n}')" for s, (ref, (_, columns, _)) in enumerate(EXPORTS.items()) for p, (n, _) in enumerate(columns)
)
PROFILE_SQL = f"""
WITH names(source, position, source_ref, column_name) AS (VALUES {NAMES}),
counts AS (SELECT source, position, value, count(*) AS n, min(ordinal) AS first_ordinal FROM ({CELLS}) GROUP BY 1, 2, 3),
stats AS (SELECT source, position, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_count,
       count(DISTINCT {norm('value')}) AS distinct_normalized,
       bool_and(regexp_matches(value, '^(19|20)[0-9]{{2}}$')) AS years, bool_and(TRY_CAST(value AS DOUBLE) IS NOT NULL) AS numbers,
       bool_and(regexp_matches(value, '^[0-9]{{2,4}}[a-zA-Z]?$')) AS codes,
       bool_and({norm('value')} IN ('', {', '.join(f"'{w}'" for w in fixed.BOOLEAN_LIKE)})) AS all_boolean
FROM counts GROUP BY 1, 2),
first AS (SELECT source, position, list({norm('value')}) AS seen FROM
       (SELECT *, row_number() OVER (PARTITION BY source, position ORDER BY first_ordinal, value) AS r FROM counts)
       WHERE r <= {fixed.EXAMPLES_LIMIT} GROUP BY 1, 2),
named AS (SELECT *, {norm('column_name')} AS normalized, {norm("source_ref || ' ' || column_name")} AS context
          FROM names JOIN stats USING (source, position) JOIN first USING (source, position)),
columns AS (SELECT *,
       CASE WHEN normalized IN ('clepers', 'cleadh', 'site') THEN 'identifier'
            WHEN starts_with(normalized, 'cle') AND distinct_count >= greatest(1, floor(row_count * 0.6)) THEN 'identifier'
            WHEN regexp_matches(normalized, 'date|debut|fin') THEN 'date'
            WHEN contains(normalized, 'id') AND distinct_count >= greatest(1, floor(row_count * 0.7)) THEN 'identifier'
            WHEN years THEN 'year' WHEN numbers THEN 'numeric' WHEN codes THEN 'code'
            WHEN distinct_normalized <= greatest(8, floor(row_count * 0.6)) THEN 'categorical' ELSE 'text' END AS inferred_type,
       CASE WHEN regexp_matches(normalized, '{words(fixed.S4_COLUMN_TOKENS)}') THEN 'S4'
            WHEN regexp_matches(normalized, '{words(fixed.S2_COLUMN_TOKENS)}') THEN 'S2'
            WHEN regexp_matches(context, '{words(fixed.S3_CONTEXT_TOKENS)}') THEN 'S3'
            WHEN regexp_matches(context, '{words(fixed.S2_CONTEXT_TOKENS)}') THEN 'S2' ELSE 'S1' END AS sensitivity,
       round_even(distinct_count / CAST(row_count AS DOUBLE), 3) AS uniqueness
FROM named),
heads AS (SELECT source, {norm('source_ref')} AS file, string_agg(normalized, ' ' ORDER BY position) AS column_names
          FROM columns GROUP BY 1, 2),
entities AS (SELECT source, {entity_sql('file', 'column_names')} AS entity_list FROM heads)"""

TARGETS = ", ".join(
    "({}, '{}', '{}', '{}', [{}])".format(
        k, f.entity, f.field, f.type, ", ".join(f"'{a}'" for a in dict.fromkeys(map(plain_normalize, f.aliases)))
    )
    for k, f in enumerate(fixed.TARGET_FIELDS)
)
COMPATIBLE = ", ".join(f"'{a}>{b}'" for a, b in fixed.COMPATIBLE_TYPES)
MATCH_SQL = PROFILE_SQL + f""",
targets(ord, entity, target_field, target_type, aliases) AS (VALUES {TARGETS}),
pairs AS (SELECT * FROM (SELECT c.*, unnest(string_split(entity_list, ',')) AS entity
                         FROM columns c JOIN entities USING (source) WHERE sensitivity <> 'S4' AND entity_list <> '')
          JOIN targets USING (entity)),
scored AS (SELECT *,
       list_max(list_transform(aliases, lambda a: CASE WHEN a = normalized THEN {double(1.0)}
           WHEN contains(a, normalized) OR contains(normalized, a) THEN {double(0.92)}
           ELSE {double(1.0)} - levenshtein(normalized, a) / CAST(greatest(length(normalized), length(a)) AS DOUBLE) END)) AS name_score,
       CASE WHEN inferred_type = target_type THEN {double(1.0)} WHEN inferred_type || '>' || target_type IN ({COMPATIBLE})
            THEN {double(0.65)} ELSE {double(0.25)} END AS type_score,
       CASE WHEN target_field = 'sexe' AND list_has_any(seen, ['f', 'm', 'femme', 'homme']) THEN {double(1.0)}
            WHEN contains(target_field, 'date') AND inferred_type = 'date' THEN {double(1.0)}
            WHEN contains(target_field, 'annee') AND inferred_type = 'year' THEN {double(1.0)}
            WHEN contains(target_field, 'region') AND regexp_matches(array_to_string(seen, ' '), 'auvergne|rhone') THEN {double(1.0)}
            WHEN contains(target_field, 'naf') AND len(list_filter(seen, lambda v: regexp_matches(v, '^[0-9]{{4}}.$'))) > 0 THEN {double(1.0)}
            WHEN contains(target_field, 'flag') AND list_has_any(seen, ['oui', 'non', 'true', 'false']) THEN {double(0.9)}
            ELSE {double(0.5)} END AS value_score
FROM pairs),
confident AS (SELECT *, round_even(name_score * {double(fixed.NAME_WEIGHT)} + type_score * {double(fixed.TYPE_WEIGHT)}
       + value_score * {double(fixed.VALUE_WEIGHT)}, 3) AS raw FROM scored),
capped AS (SELECT *, least(raw, {double(fixed.CONFIDENCE_CEILING)}) AS confidence_score FROM confident WHERE raw > {fixed.DISCARD_THRESHOLD}),
best AS (SELECT *, CASE WHEN confidence_score < {fixed.REVIEW_THRESHOLD} THEN 'ignored'
         WHEN confidence_score < {fixed.AUTO_THRESHOLD} OR target_field IN ('restriction_flag', 'amenagement_flag') AND NOT all_boolean
         THEN '{fixed.TO_REVIEW}' ELSE '{fixed.AUTO}' END AS status FROM capped
         QUALIFY row_number() OVER (PARTITION BY source, position, entity ORDER BY confidence_score DESC, ord) = 1)
SELECT source_ref, column_name AS source_column, entity, target_field, confidence_score, status FROM best WHERE status <> 'ignored'
QUALIFY row_number() OVER (PARTITION BY source, entity, target_field ORDER BY confidence_score DESC, position) = 1
"""

JOINABLE = ", ".join(f"'{t}'" for t in fixed.JOINABLE_TYPES)
CANDIDATES_SQL = PROFILE_SQL + f""",
keys AS (SELECT c.*, entity_list FROM columns c JOIN entities USING (source)
         WHERE sensitivity <> 'S4' AND inferred_type IN ({JOINABLE}) AND distinct_count > 0),
held AS (SELECT source, position, value FROM counts JOIN keys USING (source, position) WHERE value <> ''),
shared AS (SELECT a.source AS ls, a.position AS lp, b.source AS rs, b.position AS rp, count(*) AS overlap
           FROM held a JOIN held b ON a.value = b.value AND a.source < b.source GROUP BY ALL),
rated AS (SELECT l.source_ref AS left_file, l.column_name AS left_column, r.source_ref AS right_file, r.column_name AS right_column,
       l.normalized AS left_name, r.normalized AS right_name, l.uniqueness AS left_unique, r.uniqueness AS right_unique,
       l.entity_list AS left_entities, r.entity_list AS right_entities, l.inferred_type = r.inferred_type AS same_type,
       overlap / CAST(least(l.distinct_count, r.distinct_count) AS DOUBLE) AS ratio
FROM shared JOIN keys l ON l.source = ls AND l.position = lp JOIN keys r ON r.source = rs AND r.position = rp),
candidates AS (SELECT *, round_even(ratio, 3) AS overlap_ratio, round_even(least(ratio * {double(fixed.OVERLAP_WEIGHT)}
       + ({double(1.0)} - levenshtein(left_name, right_name) / CAST(greatest(length(left_name), length(right_name)) AS DOUBLE))
         * {double(fixed.RATIO_WEIGHT)} + CASE WHEN same_type THEN {double(fixed.SAME_TYPE_BONUS)} ELSE 0 END,
       {double(fixed.CONFIDENCE_CEILING)}), 3) AS confidence_score FROM rated),
kept AS (SELECT *, CASE WHEN confidence_score >= {fixed.JOIN_AUTO_THRESHOLD} THEN '{fixed.AUTO}' ELSE '{fixed.TO_REVIEW}' END AS status
         FROM candidates WHERE confidence_score >= {fixed.JOIN_KEEP_THRESHOLD})"""


def quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


ROLE = "CASE " + " ".join(
    f"WHEN left_name IN ({quoted(held)}) AND right_name IN ({quoted(held)}) THEN '{role}'" for role, _, held in fixed.KEY_ROLES
) + " END"


def anchor(side: str) -> str:
    tests = " OR ".join(f"role = '{r}' AND list_contains(string_split({side}_entities, ','), '{e}')" for r, e, _ in fixed.KEY_ROLES)
    return f"coalesce({tests}, false)"


def reference(side: str) -> str:
    return f"list_has_any(string_split({side}_entities, ','), [{quoted(fixed.REFERENCE_ENTITIES)}])"


U = fixed.UNIQUE_THRESHOLD
RULES_SQL = CANDIDATES_SQL + f""",
roled AS (SELECT *, {ROLE} AS role FROM kept),
sided AS (SELECT *, CASE
    WHEN role IS NOT NULL AND {anchor('left')} AND NOT {anchor('right')} THEN 'left'
    WHEN role IS NOT NULL AND {anchor('right')} AND NOT {anchor('left')} THEN 'right'
    WHEN role IS NOT NULL AND NOT {anchor('left')} AND NOT {anchor('right')} THEN NULL
    WHEN {reference('left')} AND NOT {reference('right')} THEN 'left' WHEN {reference('right')} AND NOT {reference('left')} THEN 'right'
    WHEN left_unique >= {U} AND right_unique < {U} THEN 'left' WHEN right_unique >= {U} AND left_unique < {U} THEN 'right' END AS side
  FROM roled),
directed AS (SELECT *, CASE side WHEN 'left' THEN left_unique WHEN 'right' THEN right_unique END AS primary_unique,
    CASE side WHEN 'left' THEN right_unique WHEN 'right' THEN left_unique END AS foreign_unique FROM sided)
SELECT substr(sha1(left_file || '|' || left_column || '|' || right_file || '|' || right_column), 1, 12) AS id,
  coalesce(role, 'generic_key') AS key_role, CASE WHEN side IS NULL THEN 'peer_key_overlap' ELSE 'primary_foreign_key' END AS join_type,
  CASE WHEN primary_unique >= {U} AND foreign_unique >= {U} THEN 'one_to_one' WHEN primary_unique >= {U} THEN 'one_to_many'
       ELSE 'many_to_many' END AS cardinality,
  CASE WHEN side IS NOT NULL AND status = '{fixed.AUTO}' THEN '{fixed.AUTO}' ELSE '{fixed.TO_REVIEW}' END AS status,
  CASE side WHEN 'left' THEN left_file WHEN 'right' THEN right_file END AS primary_file,
  CASE side WHEN 'left' THEN left_column WHEN 'right' THEN right_column END AS primary_column,
  CASE side WHEN 'left' THEN right_file WHEN 'right' THEN left_file END AS foreign_file,
  CASE side WHEN 'left' THEN right_column WHEN 'right' THEN left_column END AS foreign_column
FROM directed
"""


# --- queries ------------------------------------------------------------------------------------------
@query("schema_match", MATCH_SQL)
def schema_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the exports against the target model, with the types and entities that the engine infers."""
    profiles, counts = profiled(spark, sf_dir)
    proposals = matching.propose_mappings(profiles.columns, profiles.sources, levenshtein_score, counts)
    return proposals.select("source_ref", "source_column", "entity", "target_field", "confidence_score", "status")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles, counts = profiled(spark, sf_dir)
    return source_graph.join_candidates(profiles.columns, profiles.sources, counts, edit_ratio)


@query(
    "join_candidates",
    CANDIDATES_SQL + " SELECT left_file, left_column, right_file, right_column, overlap_ratio, confidence_score, status FROM kept",
)
def join_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_graph.ordered(candidates(spark, sf_dir)).select(
        F.col("left.source_ref").alias("left_file"), F.col("left.column").alias("left_column"),
        F.col("right.source_ref").alias("right_file"), F.col("right.column").alias("right_column"),
        "overlap_ratio", "confidence_score", "status",
    )


@query("join_rules", RULES_SQL)
def join_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_graph.join_rules(candidates(spark, sf_dir)).select(
        "id", "key_role", "join_type", "cardinality", "status",
        F.col("primary.source_ref").alias("primary_file"), F.col("primary.column").alias("primary_column"),
        F.col("foreign.source_ref").alias("foreign_file"), F.col("foreign.column").alias("foreign_column"),
    )


# --- the draft mapping and its quality rules ------------------------------------------------------------
REQUIRED = ", ".join(
    f"({i}, '{e}', {p}, '{f}')" for i, (e, names) in enumerate(fixed.REQUIRED_FIELDS.items()) for p, f in enumerate(names)
)
DRAFT_SQL = f"""
WITH proposals AS ({MATCH_SQL}), rules AS ({RULES_SQL}),
required(ord, entity, position, target_field) AS (VALUES {REQUIRED}),
automatic AS (SELECT * FROM proposals WHERE status = '{fixed.AUTO}'),
ranked AS (SELECT entity, source_ref, row_number() OVER (PARTITION BY entity ORDER BY score DESC, source_ref) AS r FROM (
    SELECT a.entity, source_ref, round_even(count(r.target_field) * 5.0 + count(DISTINCT a.target_field)
           + CAST(sum(CAST(confidence_score AS DECIMAL(12, 3))) AS DOUBLE), 3) AS score
    FROM automatic a LEFT JOIN required r USING (entity, target_field) GROUP BY 1, 2)),
fields AS (SELECT a.* FROM automatic a JOIN ranked USING (entity, source_ref) WHERE r = 1),
gaps AS (SELECT r.entity, coalesce(string_agg(r.target_field, ', ' ORDER BY r.position) FILTER (f.entity IS NULL), '') AS missing
         FROM required r LEFT JOIN fields f USING (entity, target_field) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM proposals WHERE status = '{fixed.TO_REVIEW}') AS waiting, (SELECT count(*) FROM rules) AS made,
             (SELECT count(*) FROM rules WHERE status = '{fixed.TO_REVIEW}') AS undecided)"""


def rule_sql(rule: str, failed: str, severity: str, bad: str, good: str, table: str) -> str:
    return (
        f"SELECT {rule} AS rule, CASE WHEN {failed} THEN '{severity}' ELSE 'info' END AS severity, "
        f"CASE WHEN {failed} THEN 'failed' ELSE 'passed' END AS status, CASE WHEN {failed} THEN {bad} ELSE {good} END AS message FROM {table}"
    )


def draft(spark: SparkSession, sf_dir: str) -> Mapping:
    return draft_of(*profiled(spark, sf_dir))


def draft_of(profiles: profiling.Profiles, counts: profiling.ValueCounts) -> Mapping:
    """The draft mapping, written as the workflow writes it."""
    proposals = cut_lineage(matching.propose_mappings(profiles.columns, profiles.sources, levenshtein_score, counts))
    found = cut_lineage(source_graph.join_candidates(profiles.columns, profiles.sources, counts, edit_ratio))
    return assemble(
        profiles, proposals, matching.blocked_columns(profiles.columns), found, source_graph.join_rules(found),
        source_system="suite", schema_version="v0", counts=counts,
    ).written(f"{ensure_checkpoint_dir(found.sparkSession).rstrip('/')}/mapping-{uuid.uuid4().hex}")


@query(
    "quality_rules",
    DRAFT_SQL + " " + " UNION ALL ".join([
        rule_sql("'required_mapping:' || entity", "missing <> ''", "bloquant", "'Missing required fields: ' || missing",
                 "'All required fields are mapped.'", "gaps"),
        rule_sql("DISTINCT 'mapping_source_columns:' || entity", "false", "bloquant", "''",
                 "'All mapped columns exist in ' || source_ref || '.'", "fields"),
        rule_sql("'review_queue:pending_mapping_proposals'", "waiting > 0", "alerte",
                 "waiting || ' mapping proposals require human review.'", "'No column mapping proposal is pending review.'", "n"),
        rule_sql("'source_graph:join_candidates'", "made = 0", "alerte", "'No join candidate detected between exports.'",
                 "made || ' join candidates detected between exports.'", "n"),
        rule_sql("'source_graph:explicit_join_rules'", "undecided > 0", "alerte",
                 "made || ' explicit join rules generated; ' || undecided || ' require review.'",
                 "made || ' explicit join rules generated.'", "n"),
    ]),
)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over the draft mapping: required fields, mapped columns, pending proposals, candidates, rules."""
    mapping = draft(spark, sf_dir)
    parts = [
        quality.required_mappings(mapping), quality.mapped_source_columns(mapping, {t.source_ref: t for t in exports(spark, sf_dir)}),
        quality.pending_columns(mapping), quality.candidate_count(mapping), quality.pending_rules(mapping),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "review_queue_columns",
    DRAFT_SQL + f" SELECT source_ref, source_column, entity, target_field, confidence_score FROM proposals WHERE status = '{fixed.TO_REVIEW}'",
)
def review_queue_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft(spark, sf_dir).review_queue.select("source_ref", "source_column", "entity", "target_field", "confidence_score")


@query("mapped_fields", DRAFT_SQL + " SELECT entity, target_field, source_ref, source_column, confidence_score FROM fields")
def mapped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the draft: the automatic proposals of the source chosen for each entity."""
    return draft(spark, sf_dir).fields.select("entity", "target_field", "source_ref", "source_column", "confidence_score")
