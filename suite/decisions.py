"""Decisions on the draft mapping of the exports, what they leave pending, and the records learned from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.operators import quality, review, text_model
from harmonia.plans.mapping_document import Mapping, column_review_id, review_queue
from harmonia.session import cut_lineage
from suite import query
from suite.catalogue import DRAFT_SQL, PROFILE_SQL, draft, draft_of, profiled
from suite.tables import MAPS, SETTINGS, context, resolution_usage
from suite.views import read

# Ids that begin with one of these are approved; of the others the first half is rejected.
APPROVED, REJECTED = "0123456789", "abc"


def decided(spark: SparkSession, sf_dir: str) -> tuple[Mapping, review.Reviewed]:
    mapping, (after,) = decided_each(spark, sf_dir, (False,))
    return mapping, after


def decided_each(spark: SparkSession, sf_dir: str, drop_rejected: tuple[bool, ...]) -> tuple[Mapping, list[review.Reviewed]]:
    """The draft, profiled and written once, and what a review makes of it for each choice."""
    profiles, counts = profiled(spark, sf_dir)
    mapping = draft_of(profiles, counts)
    first = F.substring("id", 1, 1)
    queue = mapping.review_queue.select(column_review_id().alias("id"))
    columns = queue.select(
        F.lit(0).cast("bigint").alias("position"), "id",
        F.when(first.isin(*APPROVED), "approve").when(first.isin(*REJECTED), "reject").otherwise("later").alias("action"),
        F.lit("r").alias("reviewer"), F.lit(None).cast("string").alias("reason"),
    )
    none = review.Decisions.from_rows(spark)
    decisions = review.Decisions(columns, none.values, none.rules)
    after = [
        review.apply_decisions(mapping, decisions, profiles.columns, drop_rejected=dropped, counts=counts, sources=profiles.sources)
        for dropped in drop_rejected
    ]
    return mapping, after


REVIEW_SQL = DRAFT_SQL + f""",
pending AS (SELECT *, substr(sha1(source_ref || '|' || source_column || '|' || entity || '|' || target_field), 1, 12) AS id
            FROM proposals WHERE status = '{fixed.TO_REVIEW}'),
accepted AS (SELECT * FROM pending WHERE regexp_matches(id, '^[{APPROVED}]')),
homes AS (SELECT entity, source_ref FROM ranked WHERE r = 1
          UNION ALL SELECT entity, source_ref FROM accepted WHERE entity NOT IN (SELECT entity FROM ranked)
          QUALIFY row_number() OVER (PARTITION BY entity ORDER BY source_ref, entity, target_field) = 1),
added AS (SELECT a.* FROM accepted a JOIN homes USING (entity, source_ref))"""


@query(
    "review_columns",
    REVIEW_SQL + f"""
SELECT entity, target_field, source_ref, source_column, '{fixed.BY_HUMAN}' AS review_status FROM added
UNION ALL SELECT entity, target_field, source_ref, source_column, status FROM fields
WHERE (entity, target_field) NOT IN (SELECT (entity, target_field) FROM added)
""",
)
def review_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the reviewed mapping: approved columns are added, and replace the field they map to."""
    return decided(spark, sf_dir)[1].mapping.fields.select("entity", "target_field", "source_ref", "source_column", "review_status")


@query(
    "review_left",
    REVIEW_SQL + f"""
SELECT 'kept' AS rejected_ones, 'pending' AS part, id FROM pending WHERE NOT regexp_matches(id, '^[{APPROVED}]')
UNION ALL SELECT 'dropped', 'pending', id FROM pending WHERE NOT regexp_matches(id, '^[{APPROVED}{REJECTED}]')
UNION ALL SELECT 'kept', 'skipped', id FROM accepted WHERE (entity, source_ref) NOT IN (SELECT (entity, source_ref) FROM homes)
""",
)
def review_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits after the review, with rejected columns kept or dropped, and the approved ones that another source keeps out."""
    found = None
    choices = (False, True)
    for dropped, after in zip(choices, decided_each(spark, sf_dir, choices)[1], strict=True):
        parts = [("pending", review_queue(after.mapping).columns)] + ([] if dropped else [("skipped", after.skipped)])
        for part, df in parts:
            rows = df.select(F.lit("dropped" if dropped else "kept").alias("rejected_ones"), F.lit(part).alias("part"), "id")
            found = rows if found is None else found.unionByName(rows)
    return found


@query(
    "review_pending",
    DRAFT_SQL + """ SELECT kind, pending FROM (SELECT 'column' AS kind, waiting AS pending FROM n UNION ALL SELECT 'rule', undecided FROM n) WHERE pending > 0""",
)
def review_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and rules that wait, by kind."""
    return review_queue(draft(spark, sf_dir)).pending_counts().where("kind <> 'value'")


@query(
    "review_same_queue",
    REVIEW_SQL + f""" SELECT true AS own_queue, count(*) FILTER (regexp_matches(id, '^[{APPROVED}]')) = 0 AS reviewed_queue FROM pending""",
)
def review_same_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a queue waits for the same ids as the draft's own, before and after a review."""
    mapping, after = decided(spark, sf_dir)
    own = review_queue(mapping)
    answers = [(own.same_pending(review_queue(mapping)), own.same_pending(review_queue(after.mapping)))]
    return spark.createDataFrame(answers, "own_queue boolean, reviewed_queue boolean")


# --- rules of the quality report -----------------------------------------------------------------------
def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as values of their brands; those of small parts wait for a review."""
    parts = read(spark, sf_dir, "part")
    grouped = parts.groupBy("p_brand", "p_type").agg(F.min("p_size").alias("least"), F.count("*").alias("count"))
    return grouped.select(
        F.col("p_brand").alias("source_ref"), F.lit("type").alias("source_column"), F.lit("e").alias("entity"), F.lit("f").alias("target_field"),
        F.crc32("p_type").alias("rank"), F.col("p_type").alias("source_value"), F.upper("p_type").alias("target_value"), "count",
        F.when(F.col("least") <= 3, fixed.TO_REVIEW).otherwise("auto").alias("status"),
    )


def _with_items(spark: SparkSession, items: DataFrame) -> Mapping:
    none = spark.range(0).toDF("id")
    return Mapping("suite", "v0", "0", "draft", none, none, none, none, items, none, none, none, none, none)


@query(
    "pending_value_rule",
    f"""
WITH items AS (SELECT p_brand, p_type, min(p_size) AS least FROM part GROUP BY 1, 2),
waiting AS (SELECT p_brand || '::type ' || p_type || '->' || upper(p_type) AS label, p_brand FROM items WHERE least <= 3),
n AS (SELECT count(*) AS n, (SELECT count(*) FROM items) AS whole FROM waiting)
SELECT 'some' AS of, 'review_queue:pending_value_mappings' AS rule, CASE WHEN n > 0 THEN 'alerte' ELSE 'info' END AS severity,
       CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status,
       CASE WHEN n > 0 THEN n || ' nomenclature values require domain review' ELSE 'No nomenclature value is pending domain review.' END AS message FROM n
UNION ALL SELECT 'none', 'review_queue:pending_value_mappings', 'info', 'passed', 'No nomenclature value is pending domain review.'
""",
)
def pending_value_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule with and without pending values; the examples in its message are cut off."""
    items = _items(spark, sf_dir)
    found = None
    for name, held in (("some", items), ("none", items.where(F.col("status") == "auto"))):
        rows = quality.pending_values(_with_items(spark, held)).select(
            F.lit(name).alias("of"), "rule", "severity", "status", F.regexp_replace("message", "review: .*", "review").alias("message")
        )
        found = rows if found is None else found.unionByName(rows)
    return found


@query(
    "resolution_rule",
    """
WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 40 < 25) AS hit FROM orders),
e AS (SELECT count(*) AS n, count(*) FILTER (user_id IN (SELECT c_custkey FROM customer)) AS hit FROM events),
p AS (SELECT count(*) AS n FROM part),
t AS (SELECT 5 * o.n + 3 * e.n + o.n + 2 * p.n AS attempted, 5 * o.n + 3 * e.hit + o.hit + 2 * p.n AS resolved FROM o, e, p),
a AS (SELECT count(*) AS ambiguous FROM (SELECT count(*) FROM nation GROUP BY n_regionkey HAVING count(*) > 1) HAVING count(*) > 0)
SELECT 'source_graph:join_resolution' AS rule, 'alerte' AS severity, 'failed' AS status,
       resolved || '/' || attempted || ' key values resolved through explicit join rules; ' || (attempted - resolved)
       || ' unresolved; 1 ambiguous primary indexes.' AS message FROM t, a
""",
)
def resolution_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key look-ups of all tables; one primary column is ambiguous, so the rule fails."""
    joins = context(spark, sf_dir)
    return quality.resolution(resolution_usage(MAPS, joins, SETTINGS), joins.index_diagnostics())


@query(
    "blocked_rule",
    PROFILE_SQL + """
SELECT 'sensitivity:S4_blocked' AS rule, 'info' AS severity, 'passed' AS status,
       count(*) FILTER (sensitivity = 'S4') || ' S4 fields excluded from the standard tables.' AS message FROM columns
""",
)
def blocked_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.blocked_fields(draft(spark, sf_dir))


# --- learning records -----------------------------------------------------------------------------------
LEARNED_SQL = DRAFT_SQL + """,
typed AS (SELECT source_ref, column_name AS source_column, inferred_type AS source_type, sensitivity FROM ({profile} SELECT * FROM columns)),
records AS (
  SELECT 'positive' AS label, f.source_ref, f.source_column, source_type, sensitivity AS source_sensitivity, entity || '.' || target_field AS target,
         f.status AS review_status FROM fields f JOIN typed USING (source_ref, source_column)
  UNION ALL SELECT 'blocked_s4', source_ref, source_column, source_type, 'S4', NULL, 'blocked_s4' FROM typed WHERE sensitivity = 'S4')""".replace(
    "{profile}", PROFILE_SQL
)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles, counts = profiled(spark, sf_dir)
    return cut_lineage(text_model.learning_records(draft_of(profiles, counts), profiles.columns).where("task = 'column_mapping'"))


@query("learning_columns", LEARNED_SQL + " SELECT * FROM records")
def learning_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped and blocked columns of the draft as examples."""
    return _records(spark, sf_dir).select(
        "label", "source_ref", "source_column", "source_type", "source_sensitivity", F.nullif("target", F.lit("")).alias("target"), "review_status"
    )


@query("learning_summary", LEARNED_SQL + " SELECT 'column_mapping' AS task, label, count(*) AS records_count FROM records GROUP BY label")
def learning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_model.dataset_summary(_records(spark, sf_dir))
