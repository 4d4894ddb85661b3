"""Cohort definitions over customers, orders, line items and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonia.operators.cohort import CohortResult, Reader, evaluate_cohort, event_predicate
from harmonia.plans.cohort_definition import CohortDefinition
from harmonia.session import ensure_checkpoint_dir
from suite import query
from suite.views import read, standard_tables

# Columns of the views above that already hold upper-case normalised text.
NORMALIZED = ("conclusion_medicale.conclusion_concept_id",)

# One CTE per standard table, for the SQL side.
TABLES_SQL = """
travailleur AS (
  SELECT CAST(c_custkey AS VARCHAR) AS travailleur_id, 1950 + c_nationkey * 2 AS annee,
         CASE WHEN c_acctbal < 0 THEN 'F' ELSE 'M' END AS sexe, c_mktsegment AS suivi, c_nationkey AS site
  FROM customer),
visite AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS visite_id, CAST(o_custkey AS VARCHAR) AS travailleur_id,
         CAST(o_orderdate AS DATE) AS date_visite, o_orderpriority AS type_visite FROM orders),
conclusion AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS visite_id, l_returnflag AS concept,
         l_linestatus = 'F' AS restriction_flag, l_discount > 0.05 AS amenagement_flag FROM lineitem),
expo AS (
  SELECT CAST(user_id AS VARCHAR) AS travailleur_id, event_type AS concept, CAST(ts AS DATE) AS d, value FROM events)
"""


def evaluate(spark: SparkSession, sf_dir: str, definition: dict) -> CohortResult:
    needed = CohortDefinition.from_dict(definition).required_tables()
    return evaluate_cohort(spark, standard_tables(spark, sf_dir, needed), definition, normalized_columns=NORMALIZED)


# --- static criteria -----------------------------------------------------------------
STATIC = {
    "name": "static",
    "reference_year": 2026,
    "population": {
        "min_age": 30, "max_age": 70, "region": ["Asia", "EUROPE", "África"],
        "sex": "m", "suivi_type": ["building", "machinery", "furniture"],
    },
    "criteria": {
        "visit_types": {"any": ["1-urgent", "2 high"]},
        "conclusions": {"any": ["r"]},
        "flags": {"restriction_flag": True, "amenagement_flag": "oui"},
    },
}

STATIC_FLAGS_SQL = f"""
WITH {TABLES_SQL},
by_visit AS (
  SELECT v.travailleur_id, bool_or(c.concept = 'R') AS f7, bool_or(c.restriction_flag) AS f8,
         bool_or(c.amenagement_flag) AS f9
  FROM conclusion c JOIN visite v USING (visite_id) GROUP BY 1),
by_type AS (
  SELECT DISTINCT travailleur_id FROM visite WHERE type_visite IN ('1-URGENT', '2-HIGH')),
flags AS (
  SELECT t.travailleur_id,
         2026 - annee >= 30 AS f1, 2026 - annee <= 70 AS f2,
         r.r_name IN ('ASIA', 'EUROPE', 'AFRICA') AS f3, sexe = 'M' AS f4,
         suivi IN ('BUILDING', 'MACHINERY', 'FURNITURE') AS f5,
         b.travailleur_id IS NOT NULL AS f6,
         coalesce(f7, false) AS f7, coalesce(f8, false) AS f8, coalesce(f9, false) AS f9
  FROM travailleur t
  LEFT JOIN nation n ON n.n_nationkey = t.site LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN by_type b ON b.travailleur_id = t.travailleur_id
  LEFT JOIN by_visit c ON c.travailleur_id = t.travailleur_id),
ladder AS (
  SELECT count(*) AS c0, count(*) FILTER (f1) AS c1, count(*) FILTER (f1 AND f2) AS c2,
         count(*) FILTER (f1 AND f2 AND f3) AS c3, count(*) FILTER (f1 AND f2 AND f3 AND f4) AS c4,
         count(*) FILTER (f1 AND f2 AND f3 AND f4 AND f5) AS c5,
         count(*) FILTER (f1 AND f2 AND f3 AND f4 AND f5 AND f6) AS c6,
         count(*) FILTER (f1 AND f2 AND f3 AND f4 AND f5 AND f6 AND f7) AS c7,
         count(*) FILTER (f1 AND f2 AND f3 AND f4 AND f5 AND f6 AND f7 AND f8) AS c8,
         count(*) FILTER (f1 AND f2 AND f3 AND f4 AND f5 AND f6 AND f7 AND f8 AND f9) AS c9
  FROM flags)
"""


@query(
    "cohort_static",
    STATIC_FLAGS_SQL
    + """
SELECT 0 AS ord, 'source_population' AS id, CAST(NULL AS BIGINT) AS input_count, c0 AS output_count,
       CAST(0 AS BIGINT) AS excluded_count FROM ladder
UNION ALL SELECT 1, 'population:min_age', c0, c1, c0 - c1 FROM ladder
UNION ALL SELECT 2, 'population:max_age', c1, c2, c1 - c2 FROM ladder
UNION ALL SELECT 3, 'population:region', c2, c3, c2 - c3 FROM ladder
UNION ALL SELECT 4, 'population:sex', c3, c4, c3 - c4 FROM ladder
UNION ALL SELECT 5, 'population:suivi_type', c4, c5, c4 - c5 FROM ladder
UNION ALL SELECT 6, 'criteria:visit_type', c5, c6, c5 - c6 FROM ladder
UNION ALL SELECT 7, 'criteria:conclusion', c6, c7, c6 - c7 FROM ladder
UNION ALL SELECT 8, 'criteria:restriction_flag', c7, c8, c7 - c8 FROM ladder
UNION ALL SELECT 9, 'criteria:amenagement_flag', c8, c9, c8 - c9 FROM ladder
""",
)
def cohort_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = evaluate(spark, sf_dir, STATIC).steps
    return steps.select("ord", "id", "input_count", "output_count", "excluded_count")


@query(
    "cohort_included",
    STATIC_FLAGS_SQL
    + "SELECT travailleur_id FROM flags WHERE f1 AND f2 AND f3 AND f4 AND f5 AND f6 AND f7 AND f8 AND f9",
)
def cohort_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(spark, sf_dir, STATIC).included


# --- event sequences --------------------------------------------------------------------
def sequence_definition(*sequences: dict) -> dict:
    return {
        "name": "sequences",
        "longitudinal": {
            "events": {
                "viewed": {"table": "exposition_professionnelle", "filters": {"exposition_concept_id": "view"}},
                "bought": {"table": "exposition_professionnelle", "filters": {"exposition_concept_id": "purchase"}},
                "failed": {"table": "exposition_professionnelle", "filters": {"exposition_concept_id": ["error"]}},
            },
            "sequences": list(sequences),
        },
    }


def worker_pairs(spark: SparkSession, sf_dir: str, *sequences: dict) -> DataFrame:
    """Customers with their event records and pairs of the first sequence."""
    workers = evaluate(spark, sf_dir, sequence_definition(*sequences)).workers
    return workers.where("_source").select(
        "travailleur_id",
        F.col("records_0").cast("bigint").alias("viewed"),
        F.col("records_1").cast("bigint").alias("bought"),
        F.col("pairs_0").cast("bigint").alias("pairs"),
    )


def pairs_sql(condition: str) -> str:
    return f"""
WITH {TABLES_SQL},
per AS (
  SELECT travailleur_id, count(*) FILTER (concept = 'view') AS viewed,
         count(*) FILTER (concept = 'purchase') AS bought FROM expo GROUP BY 1),
pairs AS (
  SELECT a.travailleur_id, count(*) AS n FROM expo a JOIN expo b
    ON a.travailleur_id = b.travailleur_id AND a.concept = 'view' AND b.concept = 'purchase' AND ({condition})
  GROUP BY 1)
SELECT t.travailleur_id, coalesce(viewed, 0) AS viewed, coalesce(bought, 0) AS bought, coalesce(n, 0) AS pairs
FROM travailleur t LEFT JOIN per USING (travailleur_id) LEFT JOIN pairs USING (travailleur_id)
"""


VIEW_BUY = {"first": "viewed", "then": "bought"}


@query("cohort_sequence_before", pairs_sql("date_diff('day', a.d, b.d) BETWEEN 0 AND 7"))
def cohort_sequence_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worker_pairs(spark, sf_dir, {**VIEW_BUY, "relation": "before", "max_days": 7})


@query("cohort_sequence_after", pairs_sql("date_diff('day', b.d, a.d) >= 2"))
def cohort_sequence_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worker_pairs(spark, sf_dir, {**VIEW_BUY, "relation": "after", "min_days": 2})


@query("cohort_sequence_same_day", pairs_sql("a.d = b.d"))
def cohort_sequence_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worker_pairs(spark, sf_dir, {**VIEW_BUY, "relation": "same_day"})


@query("cohort_sequence_strict", pairs_sql("date_diff('day', a.d, b.d) BETWEEN 1 AND 3"))
def cohort_sequence_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worker_pairs(spark, sf_dir, {**VIEW_BUY, "relation": "strictly_before", "max_days": 3})


@query(
    "cohort_multi_sequence",
    f"""
WITH {TABLES_SQL},
e AS (SELECT x.* FROM expo x SEMI JOIN travailleur t ON x.travailleur_id = t.travailleur_id),
p1 AS (SELECT a.travailleur_id, count(*) AS n FROM e a JOIN e b
       ON a.travailleur_id = b.travailleur_id AND a.concept = 'view' AND b.concept = 'purchase'
       AND date_diff('day', a.d, b.d) BETWEEN 0 AND 0 GROUP BY 1),
p2 AS (SELECT a.travailleur_id, count(*) AS n FROM e a JOIN e b
       ON a.travailleur_id = b.travailleur_id AND a.concept = 'purchase' AND b.concept = 'error'
       AND date_diff('day', a.d, b.d) BETWEEN 1 AND 1 GROUP BY 1),
p3 AS (SELECT a.travailleur_id, count(*) AS n FROM e a JOIN e b
       ON a.travailleur_id = b.travailleur_id AND a.concept = 'error' AND b.concept = 'view'
       AND abs(date_diff('day', a.d, b.d)) BETWEEN 25 AND 28 GROUP BY 1),
w AS (SELECT t.travailleur_id, coalesce(p1.n, 0) AS n1, coalesce(p2.n, 0) AS n2, coalesce(p3.n, 0) AS n3
      FROM travailleur t LEFT JOIN p1 USING (travailleur_id) LEFT JOIN p2 USING (travailleur_id)
      LEFT JOIN p3 USING (travailleur_id))
SELECT 0 AS ord, 's1' AS id, CAST(coalesce(sum(n1), 0) AS BIGINT) AS matched_pairs_count,
       count(*) FILTER (n1 > 0) AS matched_workers_count FROM w
UNION ALL SELECT 1, 's2', CAST(coalesce(sum(n2) FILTER (n1 > 0), 0) AS BIGINT), count(*) FILTER (n1 > 0 AND n2 > 0) FROM w
UNION ALL SELECT 2, 's3', CAST(coalesce(sum(n3) FILTER (n1 > 0 AND n2 > 0), 0) AS BIGINT),
       count(*) FILTER (n1 > 0 AND n2 > 0 AND n3 > 0) FROM w
""",
)
def cohort_multi_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = evaluate(
        spark, sf_dir,
        sequence_definition(
            {"id": "s1", **VIEW_BUY, "relation": "before", "max_days": 0},
            {"id": "s2", "first": "bought", "then": "failed", "relation": "strictly before", "max_days": 1},
            {"id": "s3", "first": "failed", "then": "viewed", "relation": "same_day", "min_days": 25, "max_days": 28},
        ),
    )
    return result.sequences.select("ord", "id", "matched_pairs_count", "matched_workers_count")


LINKED = {
    "name": "linked",
    "reference_year": 2026,
    "population": {"min_age": 40},
    "longitudinal": {
        "events": {
            "returned": {
                "table": "conclusion_medicale",
                "filters": {"conclusion_concept_id": {"any": ["r"]}, "restriction_flag": True},
            },
            "urgent": {
                "table": "visite_sante_travail",
                "filters": {"type_visite_concept_id": {"not_any": ["5-low", "4-not specified", "3-medium", "2-high"]}},
            },
        },
        "sequences": {"returned_before_urgent": {"first": "returned", "then": "urgent", "min_days": 1, "max_days": 60}},
    },
}

LINKED_SQL = f"""
WITH {TABLES_SQL},
first_e AS (SELECT v.travailleur_id, v.date_visite AS d FROM conclusion c JOIN visite v USING (visite_id)
            WHERE c.concept = 'R' AND c.restriction_flag),
then_e AS (SELECT travailleur_id, date_visite AS d FROM visite WHERE type_visite = '1-URGENT'),
pairs AS (SELECT a.travailleur_id, count(*) AS n FROM first_e a JOIN then_e b
          ON a.travailleur_id = b.travailleur_id AND date_diff('day', a.d, b.d) BETWEEN 1 AND 60 GROUP BY 1),
w AS (SELECT t.travailleur_id, 2026 - annee >= 40 AS f1, coalesce(n, 0) AS n
      FROM travailleur t LEFT JOIN pairs USING (travailleur_id))
"""


@query(
    "cohort_linked_date",
    LINKED_SQL
    + """
SELECT 0 AS ord, 'source_population' AS id, CAST(NULL AS BIGINT) AS input_count, count(*) AS output_count,
       CAST(0 AS BIGINT) AS excluded_count, CAST(NULL AS BIGINT) AS matched_pairs_count FROM w
UNION ALL SELECT 1, 'population:min_age', count(*), count(*) FILTER (f1), count(*) FILTER (NOT f1), NULL FROM w
UNION ALL SELECT 2, 'longitudinal:returned_before_urgent', count(*) FILTER (f1), count(*) FILTER (f1 AND n > 0),
       count(*) FILTER (f1 AND n = 0), CAST(sum(n) FILTER (f1) AS BIGINT) FROM w
""",
)
def cohort_linked_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(spark, sf_dir, LINKED).steps.drop("label")


@query(
    "cohort_event_summary",
    LINKED_SQL
    + """
SELECT 'returned' AS id, 'conclusion_medicale' AS "table", count(*) AS records_count,
       count(DISTINCT travailleur_id) AS workers_count FROM first_e
UNION ALL SELECT 'urgent', 'visite_sante_travail', count(*), count(DISTINCT travailleur_id) FROM then_e
""",
)
def cohort_event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(spark, sf_dir, LINKED).events.select("id", "table", "records_count", "workers_count")


@query(
    "cohort_summary",
    LINKED_SQL
    + """
SELECT 'linked' AS cohort_name, 'cohort-v0.2' AS schema_version,
       CASE WHEN count(*) > 0 AND count(*) FILTER (f1 AND n > 0) = 0 THEN 'feasible_empty' ELSE 'feasible' END
         AS feasibility_status,
       count(*) AS source_population_count, count(*) FILTER (f1 AND n > 0) AS included_count,
       count(*) - count(*) FILTER (f1 AND n > 0) AS excluded_count,
       'conclusion_medicale,travailleur,visite_sante_travail' AS required_tables, '' AS missing_tables,
       CAST(1 AS BIGINT) AS longitudinal_sequences_count,
       CAST(sum(n) FILTER (f1) = 0 AS BIGINT) AS warning_diagnostics_count
FROM w
""",
)
def cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(spark, sf_dir, LINKED).summary.drop("blocking_diagnostics_count", "diagnostics_count")


INFEASIBLE = {
    "name": "infeasible",
    "reference_year": 2026,
    "population": {"min_age": 30, "sex": "F"},
    "criteria": {"flags": {"inaptitude_flag": True}},
    "longitudinal": {
        "events": {
            "never": {"table": "exposition_professionnelle", "filters": {"exposition_concept_id": "no such event"}},
            "viewed": {"table": "exposition_professionnelle", "filters": {"exposition_concept_id": "view"}},
        },
        "sequences": [{"id": "never_viewed", "first": "never", "then": "viewed"}],
    },
}


@query(
    "cohort_diagnostics",
    """
SELECT 'blocking' AS severity, 'missing_field' AS code, 'conclusion_medicale' AS "table",
       'inaptitude_flag' AS field, CAST(NULL AS VARCHAR) AS subject
WHERE (SELECT count(*) FROM lineitem) > 0
UNION ALL SELECT 'warning', 'empty_event', 'exposition_professionnelle', NULL, 'never'
WHERE (SELECT count(*) FROM events WHERE event_type = 'no such event') = 0
UNION ALL SELECT 'warning', 'temporal_no_match', NULL, NULL, 'never_viewed'
WHERE (SELECT count(*) FROM events WHERE event_type = 'no such event') = 0
""",
)
def cohort_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(spark, sf_dir, INFEASIBLE).diagnostics.drop("message")


@query(
    "cohort_availability",
    """
SELECT 'travailleur' AS "table", 'available' AS status, count(*) AS row_count FROM customer
UNION ALL SELECT 'conclusion_medicale', 'available', count(*) FROM lineitem
UNION ALL SELECT 'visite_sante_travail', 'available', count(*) FROM orders
""",
)
def cohort_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(spark, sf_dir, LINKED).availability


@query(
    "event_predicates",
    """
SELECT event_id, event_type IN ('view', 'purchase') AS listed, event_type <> 'error' AS excluded,
       event_type = 'click' AS exact, event_type = 'signup' AND CAST(value AS INT) >= 0 AS first_key_wins
FROM events
""",
)
def event_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    reader = Reader({"events": events})

    def test(expected: object) -> object:
        return event_predicate(reader, "events", {"event_type": expected})

    return events.select(
        "event_id",
        test(["View", "PURCHASE"]).alias("listed"),
        test({"not_any": ["error"]}).alias("excluded"),
        test({"equals": "Click"}).alias("exact"),
        (test({"any": ["signup"], "equals": "click", "not_any": ["signup"]})
         & event_predicate(reader, "events", {"no_such_column": {"not_any": ["x"]}})).alias("first_key_wins"),
    )


# --- exposure criterion, saved results, feasibility ----------------------------------------------------
EXPOSED = {
    "name": "exposed", "reference_year": 2026, "population": {"min_age": 50},
    "criteria": {"exposures": {"any": ["Sign-up", "purchase"]}},
}
EXPOSED_SQL = f"""
WITH {TABLES_SQL},
f AS (SELECT 2026 - annee >= 50 AS f1, travailleur_id IN (SELECT travailleur_id FROM expo WHERE concept IN ('sign_up', 'purchase')) AS f2 FROM travailleur),
c AS (SELECT count(*) AS c0, count(*) FILTER (f1) AS c1, count(*) FILTER (f1 AND f2) AS c2 FROM f)"""


@query(
    "cohort_exposure",
    EXPOSED_SQL + """
SELECT 0 AS ord, 'source_population' AS id, c0 AS output_count, CAST(0 AS BIGINT) AS excluded_count, c2 AS included FROM c
UNION ALL SELECT 1, 'population:min_age', c1, c0 - c1, c2 FROM c
UNION ALL SELECT 2, 'criteria:exposure', c2, c1 - c2, c2 FROM c
""",
)
def cohort_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cohort by exposure, saved and read back."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cohort-{uuid.uuid4().hex}"
    evaluate(spark, sf_dir, EXPOSED).save(folder)
    included = spark.read.parquet(f"{folder}/included").agg(F.count("*").alias("included"))
    return spark.read.parquet(f"{folder}/steps").select("ord", "id", "output_count", "excluded_count").crossJoin(F.broadcast(included))


@query(
    "cohort_feasibility",
    """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (2026 - (1950 + c_nationkey * 2) >= 50) AS old FROM customer)
SELECT 'feasible' AS cohort_name, 'feasible' AS feasibility_status, n AS source_population_count, old AS included_count, '' AS missing_tables,
       CAST(0 AS BIGINT) AS blocking, CAST(0 AS BIGINT) AS warnings FROM n
UNION ALL SELECT 'nobody', 'feasible_empty', n, 0, '', 0, 0 FROM n
UNION ALL SELECT 'absent_table', 'not_feasible', n, 0, 'exposition_professionnelle', 1, 0 FROM n
UNION ALL SELECT 'empty_table', 'feasible_empty', n, 0, '', 0, 1 FROM n
""",
)
def cohort_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that find workers, find none, lack a table, and read an empty one."""
    old = {"reference_year": 2026, "population": {"min_age": 50}}
    whole = standard_tables(spark, sf_dir, ["travailleur", "exposition_professionnelle"])
    workers = {"travailleur": whole["travailleur"]}
    empty = {**workers, "exposition_professionnelle": whole["exposition_professionnelle"].where("false")}
    found = None
    for definition, tables in (
        ({**old, "name": "feasible"}, whole), ({"name": "nobody", "reference_year": 2026, "population": {"min_age": 200}}, whole),
        ({**EXPOSED, "name": "absent_table"}, workers), ({**EXPOSED, "name": "empty_table"}, empty),
    ):
        row = evaluate_cohort(spark, tables, definition).summary.select(
            "cohort_name", "feasibility_status", "source_population_count", "included_count", "missing_tables",
            F.col("blocking_diagnostics_count").alias("blocking"), F.col("warning_diagnostics_count").alias("warnings"),
        )
        found = row if found is None else found.unionByName(row)
    return found
