"""The thirteen standard tables built from the given tables, and key resolution.

Sources are the given tables read as text; each entity maps some of their
columns.  Worker keys resolve through rules to the customer table, site keys to
the nation table.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonia.operators import key_resolution
from harmonia.operators.key_resolution import JoinContext, Rule
from harmonia.operators.skew import join_unique, last_row_wins
from harmonia.operators.standard_tables import SPEC_BY_NAME, EntityMap, Settings, build_table, public_columns, resolution_usage
from harmonia.operators.table_run import TableRun, run_tables
from harmonia.session import ensure_checkpoint_dir
from harmonia.sources.exports import SourceTable
from suite import query
from suite.sqltext import flag, norm, pseudonym, size_band, upper
from suite.views import read

SETTINGS = Settings(salt="suite-salt", reference_year=2026)

# Source, its columns as SQL over the given table, and the row order.
SOURCES = {
    "customer": ("customer", ["c_custkey", "c_name", "1940 + c_nationkey * 3 AS c_year", "c_mktsegment"], "c_custkey"),
    "supplier": ("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "s_suppkey"),
    "nation": ("nation", ["n_nationkey", "n_name", "n_regionkey"], "n_nationkey"),
    "part": ("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_size % 25 AS p_site"], "p_partkey"),
    "orders": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_orderkey % 40 AS o_site"], "o_orderkey"),
    "events": ("events", ["user_id", "ts", "event_type", "value", "props", "event_id"], "event_id"),
}

MAPS = {
    "travailleur": EntityMap("customer", {"travailleur_id": "c_custkey", "annee_naissance": "c_year", "sexe": "c_name", "suivi_type_concept_id": "c_mktsegment"}),
    "entreprise": EntityMap("supplier", {"entreprise_id": "s_name", "secteur_naf": "s_nationkey", "taille_classe": "s_acctbal", "region": "s_name"}),
    "etablissement": EntityMap("part", {"etablissement_id": "p_brand", "entreprise_id": "p_type", "taille_classe": "p_size", "region": "p_name"}),
    "unite_travail": EntityMap("part", {"unite_travail_id": "p_type", "etablissement_id": "p_brand"}),
    "episode_poste": EntityMap("orders", {"travailleur_id": "o_custkey", "etablissement_id": "o_orderstatus", "intitule_poste_source": "o_orderpriority", "unite_travail_id": "o_orderstatus", "date_debut": "o_orderdate"}),
    "visite_sante_travail": EntityMap("orders", {"travailleur_id": "o_custkey", "date_visite": "o_orderdate", "type_visite_concept_id": "o_orderpriority", "motif_visite_concept_id": "o_orderstatus", "professionnel_role": "o_orderstatus"}),
    "conclusion_medicale": EntityMap("orders", {"conclusion_concept_id": "o_orderpriority", "restriction_flag": "o_orderstatus"}),
    "exposition_professionnelle": EntityMap("events", {"travailleur_id": "user_id", "exposition_concept_id": "event_type", "niveau_classe": "value", "date_debut": "ts"}),
    "examen_complementaire": EntityMap("events", {"travailleur_id": "user_id", "date_examen": "ts", "examen_type_concept_id": "event_type", "resultat_valeur": "value", "resultat_unite": "event_type"}),
    "pathologie_atmp": EntityMap("events", {"travailleur_id": "user_id", "date_evenement": "ts", "type_evenement": "event_type", "code_cim10": "props", "reconnaissance_statut": "event_type"}),
    "arret_travail": EntityMap("orders", {"travailleur_id": "o_custkey", "date_debut": "o_orderdate", "date_fin": "o_orderdate", "type_arret": "o_orderpriority", "lie_atmp_flag": "o_orderstatus"}),
    "vaccination": EntityMap("orders", {"travailleur_id": "o_custkey", "vaccin_concept_id": "o_orderpriority", "date_vaccination": "o_orderdate", "statut_vaccinal": "o_orderstatus"}),
    "risque_unite_travail": EntityMap("part", {"etablissement_id": "p_brand", "unite_travail_id": "p_type", "risque_concept_id": "p_name", "niveau_risque": "p_size", "mesure_prevention_source": "p_name"}),
}

RULES = [
    Rule("r1", "travailleur_id", "customer", "c_custkey", "orders", "o_custkey", 1.0, 0.99),
    Rule("r2", "travailleur_id", "customer", "c_custkey", "events", "user_id", 1.0, 0.99),
    # Forty order sites against twenty-five nations: the rest fall back to the row's own column.
    Rule("r3", "etablissement_id", "nation", "n_nationkey", "orders", "o_site", 1.0, 0.9),
    # An ambiguous primary column never resolves, so the next rule decides.
    Rule("r4", "etablissement_id", "nation", "n_regionkey", "part", "p_site", 1.0, 0.95),
    Rule("r5", "etablissement_id", "nation", "n_nationkey", "part", "p_site", 1.0, 0.9),
]


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as the source graph writes them, worst first, with two that may not resolve keys.

    Were the undecided or the many-to-many rule used, orders would get the keys of customers as sites.
    """
    usable = [(r, "auto_validable", "one_to_many") for r in reversed(RULES)]
    tempting = Rule("r0", "etablissement_id", "customer", "c_custkey", "orders", "o_site", 1.0, 0.99)
    barred = [(tempting, "a_revoir", "one_to_many"), (tempting, "auto_validable", "many_to_many")]
    side = "struct<source_ref:string,column:string,uniqueness_ratio:double>"
    return spark.createDataFrame(
        [
            (r.id, r.key_role, status, "primary_foreign_key", cardinality, r.confidence,
             (r.primary_source, r.primary_column, r.primary_uniqueness), (r.foreign_source, r.foreign_column, 0.5))
            for r, status, cardinality in usable + barred
        ],
        "id string, key_role string, status string, join_type string, cardinality string, confidence_score double, "
        f"primary {side}, foreign {side}",
    )


def source(spark: SparkSession, sf_dir: str, name: str) -> SourceTable:
    table, columns, order = SOURCES[name]
    df = read(spark, sf_dir, table).selectExpr(*columns)
    return SourceTable.from_dataframe(name, df, F.col(order) + 1)


def context(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> JoinContext:
    return JoinContext.build({n: source(spark, sf_dir, n) for n in names or SOURCES}, rule_table(spark))


def build(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    needed = [MAPS[entity].source_ref, "customer", "nation"]
    made = build_table(spark, SPEC_BY_NAME[entity], MAPS, context(spark, sf_dir, list(dict.fromkeys(needed))), SETTINGS)
    return public_columns(made).drop("source_id")


def ids(prefix: str, *parts: str) -> str:
    return pseudonym(prefix, *parts)


ORDERS = "SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey + 1 AS ordinal FROM orders"
# A timestamp cell is written as ISO text; fractions only where there are any.
EVENTS = (
    "SELECT *, CASE WHEN ts = date_trunc('day', ts) THEN strftime(ts, '%Y-%m-%d') "
    "WHEN microsecond(ts) % 1000000 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') "
    "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS cell, event_id + 1 AS ordinal FROM events"
)
PARTS = "SELECT *, CAST(p_size % 25 AS VARCHAR) AS site, p_partkey + 1 AS ordinal FROM part"
VISIT_TYPE = upper("o_orderpriority")


def exposure(x: str) -> str:
    n = norm(x)
    return (
        f"CASE WHEN contains({n}, 'bois') OR contains({n}, 'chim') OR contains({n}, 'poussiere') THEN 'POUSSIERES_BOIS' "
        f"WHEN contains({n}, 'manutention') THEN 'MANUTENTION_MANUELLE' "
        f"WHEN contains({n}, 'repetitif') OR contains({n}, 'gestes') THEN 'GESTES_REPETITIFS' ELSE {upper(x)} END"
    )


def last_of(key: str, table: str) -> str:
    return f"SELECT * FROM ({table}) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ordinal DESC) = 1"


TABLE_SQL = {
    "travailleur": f"""
SELECT {ids('T', 'c_custkey')} AS travailleur_id, 1940 + c_nationkey * 3 AS annee_naissance,
       CASE WHEN 2026 - (1940 + c_nationkey * 3) < 30 THEN 'AGE_18_29' WHEN 2026 - (1940 + c_nationkey * 3) < 45 THEN 'AGE_30_44'
            WHEN 2026 - (1940 + c_nationkey * 3) < 55 THEN 'AGE_45_54' ELSE 'AGE_55_PLUS' END AS age_classe,
       'INCONNU' AS sexe, c_mktsegment AS suivi_type_concept_id, 'S3' AS sensitivity_level FROM customer""",
    "entreprise": f"""
WITH s AS ({last_of('s_name', 'SELECT *, s_suppkey AS ordinal FROM supplier')})
SELECT {ids('E', 's_name')} AS entreprise_id, CAST(s_nationkey AS VARCHAR) AS secteur_naf, {size_band('s_acctbal')} AS taille_classe,
       s_name AS region, 'S1' AS sensitivity_level FROM s""",
    "etablissement": f"""
WITH p AS ({last_of('p_brand', PARTS)})
SELECT {ids('ET', 'p_brand')} AS etablissement_id, {ids('E', 'p_type')} AS entreprise_id, '' AS secteur_naf,
       {size_band('p_size')} AS taille_classe, p_name AS region, 'S1' AS sensitivity_level FROM p""",
    "unite_travail": f"""
WITH p AS ({last_of('site, p_type', PARTS)})
SELECT {ids('UT', 'site', 'p_type')} AS unite_travail_id, {ids('ET', 'site')} AS etablissement_id, p_type AS libelle_unite_source,
       {upper('p_type')} AS unite_travail_concept_id, 'S2' AS sensitivity_level FROM p""",
    "episode_poste": f"""
WITH o AS (SELECT *, CASE WHEN o_orderkey % 40 < 25 THEN CAST(o_orderkey % 40 AS VARCHAR) ELSE o_orderstatus END AS site FROM ({ORDERS}))
SELECT {ids('EP', 'o_custkey', 'o_orderpriority', 'ordinal')} AS episode_poste_id, {ids('T', 'o_custkey')} AS travailleur_id,
       {ids('ET', 'site')} AS etablissement_id, {ids('UT', 'site', 'o_orderstatus')} AS unite_travail_id,
       o_orderpriority AS intitule_poste_source, {VISIT_TYPE} AS poste_concept_id, CAST(o_orderdate AS DATE) AS date_debut,
       CAST(NULL AS DATE) AS date_fin, 'S2' AS sensitivity_level FROM o""",
    "visite_sante_travail": f"""
SELECT {ids('V', 'o_custkey', 'day', 'o_orderpriority')} AS visite_id, {ids('T', 'o_custkey')} AS travailleur_id,
       CAST(o_orderdate AS DATE) AS date_visite, {VISIT_TYPE} AS type_visite_concept_id, o_orderstatus AS motif_visite_concept_id,
       o_orderstatus AS professionnel_role, 'S3' AS sensitivity_level FROM ({ORDERS})""",
    "conclusion_medicale": f"""
SELECT {ids('C', 'o_custkey', 'day', 'o_orderpriority')} AS conclusion_id, {ids('V', 'o_custkey', 'day', 'o_orderpriority')} AS visite_id,
       {VISIT_TYPE} AS conclusion_concept_id, true AS restriction_flag, false AS amenagement_flag, false AS inaptitude_flag,
       contains({norm('o_orderpriority')}, 'pdp') AS orientation_pdp_flag, 'S3' AS sensitivity_level FROM ({ORDERS})""",
    "exposition_professionnelle": f"""
SELECT {ids('X', 'user_id', 'event_type', 'ordinal')} AS exposition_id, {ids('T', 'user_id')} AS travailleur_id,
       {exposure('event_type')} AS exposition_concept_id, 'AUTRE' AS categorie_exposition, {upper('CAST(value AS VARCHAR)')} AS niveau_classe,
       CAST(ts AS DATE) AS date_debut, CAST(NULL AS DATE) AS date_fin, '' AS source_exposition_type, 'S3' AS sensitivity_level
FROM ({EVENTS})""",
    "examen_complementaire": f"""
SELECT {ids('EX', 'user_id', 'cell', 'event_type', 'ordinal')} AS examen_id, {ids('T', 'user_id')} AS travailleur_id,
       CAST(ts AS DATE) AS date_examen, {upper('event_type')} AS examen_type_concept_id, value AS resultat_valeur,
       event_type AS resultat_unite, '' AS interpretation_concept_id, 'S3' AS sensitivity_level FROM ({EVENTS})""",
    "pathologie_atmp": f"""
SELECT {ids('PA', 'user_id', 'cell', 'event_type', 'ordinal')} AS pathologie_atmp_id, {ids('T', 'user_id')} AS travailleur_id,
       CAST(ts AS DATE) AS date_evenement, {upper('event_type')} AS type_evenement, {upper('props')} AS code_cim10,
       '' AS pathologie_concept_id, {flag('event_type')} AS reconnaissance_flag, 'S3' AS sensitivity_level FROM ({EVENTS})""",
    "arret_travail": f"""
SELECT {ids('AR', 'o_custkey', 'day', 'ordinal')} AS arret_travail_id, {ids('T', 'o_custkey')} AS travailleur_id,
       CAST(o_orderdate AS DATE) AS date_debut, CAST(o_orderdate AS DATE) AS date_fin, {VISIT_TYPE} AS type_arret,
       {flag('o_orderstatus')} AS lie_atmp_flag, 'S3' AS sensitivity_level FROM ({ORDERS})""",
    "vaccination": f"""
SELECT {ids('VAC', 'o_custkey', 'o_orderpriority', 'ordinal')} AS vaccination_id, {ids('T', 'o_custkey')} AS travailleur_id,
       {VISIT_TYPE} AS vaccin_concept_id, CAST(o_orderdate AS DATE) AS date_vaccination, o_orderstatus AS statut_vaccinal,
       CAST(NULL AS DATE) AS rappel_prevu, 'S3' AS sensitivity_level FROM ({ORDERS})""",
    "risque_unite_travail": f"""
SELECT {ids('RUT', 'site', 'p_type', 'p_name', 'ordinal')} AS risque_unite_travail_id, {ids('ET', 'site')} AS etablissement_id,
       {ids('UT', 'site', 'p_type')} AS unite_travail_id, {exposure('p_name')} AS risque_concept_id, CAST(p_size AS VARCHAR) AS niveau_risque,
       p_name AS mesure_prevention_source, CAST(NULL AS DATE) AS date_evaluation, 'S3' AS sensitivity_level FROM ({PARTS})""",
}


def _register(entity: str) -> None:
    @query(f"table_{entity}", TABLE_SQL[entity])
    def build_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(spark, sf_dir, entity)


for _entity in MAPS:
    _register(_entity)


# --- keys --------------------------------------------------------------------------------------
@query("unique_index", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1")
def unique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_resolution.unique_index(read(spark, sf_dir, "lineitem"), "l_orderkey")


@query("ambiguous_keys", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def ambiguous_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_resolution.ambiguous_keys(read(spark, sf_dir, "lineitem"), "l_orderkey")


@query(
    "resolve_keys",
    """
SELECT o_orderkey + 1 AS ordinal, CASE WHEN o_orderkey % 40 < 25 THEN CAST(o_orderkey % 40 AS VARCHAR) ELSE o_orderstatus END AS site,
       o_orderkey % 40 < 25 AS site_resolved
FROM orders
""",
)
def resolve_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    joins = context(spark, sf_dir, ["orders", "nation"])
    orders = joins.sources["orders"]
    return joins.resolve(orders.df, orders, "etablissement_id", "o_orderstatus", "site").select("ordinal", "site", "site_resolved")


@query(
    "resolve_keys_hot",
    """
SELECT user_id AS k, event_id, CASE WHEN n = 1 THEN CAST(user_id AS VARCHAR) END AS resolved
FROM events LEFT JOIN (SELECT c_custkey, count(*) AS n FROM customer GROUP BY 1) ON c_custkey = user_id
""",
)
def resolve_keys_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key with ten events or more counts as hot, so the split join runs at any scale."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id")
    index = key_resolution.unique_index(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")
    joined = join_unique(events, index.withColumn("resolved", F.col("k").cast("string")), "k", min_rows=10)
    return joined.select("k", "event_id", "resolved")


@query(
    "resolution_usage",
    """
WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 40 < 25) AS hit FROM orders),
e AS (SELECT count(*) AS n, count(*) FILTER (user_id IN (SELECT c_custkey FROM customer)) AS hit FROM events),
p AS (SELECT count(*) AS n FROM part),
t AS (SELECT unnest(['episode_poste', 'visite_sante_travail', 'conclusion_medicale', 'arret_travail', 'vaccination']) AS "table"),
u AS (SELECT unnest(['exposition_professionnelle', 'examen_complementaire', 'pathologie_atmp']) AS "table"),
s AS (SELECT unnest(['unite_travail', 'risque_unite_travail']) AS "table")
SELECT "table", 'travailleur_id' AS key_role, n AS attempted, n AS resolved, CAST(0 AS BIGINT) AS missed FROM t, o
UNION ALL SELECT "table", 'travailleur_id', n, hit, n - hit FROM u, e
UNION ALL SELECT 'episode_poste', 'etablissement_id', n, hit, n - hit FROM o
UNION ALL SELECT "table", 'etablissement_id', n, n, 0 FROM s, p
""",
)
def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution_usage(MAPS, context(spark, sf_dir), SETTINGS)


@query(
    "index_diagnostics",
    """
SELECT 'nation' AS source_ref, 'n_regionkey' AS column_name, count(*) AS duplicate_values_count,
       array_to_string(list_sort(list(k))[1:5], ',') AS first_values
FROM (SELECT CAST(n_regionkey AS VARCHAR) AS k FROM nation GROUP BY 1 HAVING count(*) > 1)
HAVING count(*) > 0
""",
)
def index_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context(spark, sf_dir, ["customer", "nation"]).index_diagnostics()
    return found.select(
        "source_ref", F.col("column").alias("column_name"), "duplicate_values_count",
        F.array_join("duplicate_values", ",").alias("first_values"),
    )


@query(
    "last_row_wins",
    """
SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority, first_order FROM (
  SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_order,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rank FROM orders) WHERE rank = 1
""",
)
def last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    return last_row_wins(orders, ["o_custkey"], F.col("o_orderkey"))


# --- the whole run --------------------------------------------------------------------------------------
# Some orders and events lose their worker, so that rows are lost and keys missed.
GAPS = {
    "orders": ["o_orderkey", "CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS o_custkey", *SOURCES["orders"][1][2:]],
    "events": ["CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id", *SOURCES["events"][1][1:]],
}
KEPT = {"orders": "o_orderkey % 11 <> 0", "events": "event_id % 5 <> 0"}


def run_of(spark: SparkSession, sf_dir: str) -> TableRun:
    made = {}
    for name, (given, columns, order) in SOURCES.items():
        df = read(spark, sf_dir, given).selectExpr(*GAPS.get(name, columns))
        made[name] = SourceTable.from_dataframe(name, df, F.col(order) + 1)
    joins = JoinContext.build(made, rule_table(spark))
    return run_tables(spark, MAPS, joins, SETTINGS, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}")


def run_sql(entity: str) -> str:
    """A table's SQL over the rows that have their worker."""
    sql = TABLE_SQL[entity]
    for name, kept in KEPT.items():
        sql = sql.replace(f"FROM {name})", f"FROM (SELECT * FROM {name} WHERE {kept}))")
    return sql


def _id_of(entity: str) -> str:
    """A table's id is its first column."""
    return re.findall(r" AS (\w+_id)\b", TABLE_SQL[entity])[0]


@query(
    "table_run_tables",
    " UNION ALL ".join(
        f"""SELECT '{e}' AS "table", count(*) AS row_count, min({_id_of(e)}) AS first_id, max({_id_of(e)}) AS last_id, count(DISTINCT {_id_of(e)}) AS ids FROM ({run_sql(e)})"""
        for e in MAPS
    ),
)
def table_run_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen tables as one run has written them."""
    found = None
    for name, df in run_of(spark, sf_dir).tables.items():
        key = df.columns[0]
        row = df.agg(
            F.count("*").alias("row_count"), F.min(key).alias("first_id"), F.max(key).alias("last_id"), F.count_distinct(key).alias("ids")
        ).select(F.lit(name).alias("table"), "*")
        found = row if found is None else found.unionByName(row)
    return found


def _loss_sql(entity: str) -> str:
    given = SOURCES[MAPS[entity].source_ref][0]
    kept = KEPT.get(given, "true")
    return (
        f"""SELECT '{entity}' AS "table", count(*) AS source_rows, count(*) FILTER ({kept}) AS kept_rows, count(*) FILTER (NOT ({kept})) AS lost_rows, """
        f"(SELECT count(*) FROM ({run_sql(entity)})) AS row_count FROM {given}"
    )


@query("table_run_losses", " UNION ALL ".join(map(_loss_sql, MAPS)))
def table_run_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read, kept, lost and written, observed in the writes."""
    return run_of(spark, sf_dir).losses


@query(
    "table_run_usage",
    """
WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 11 <> 0) AS kept, count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 40 < 25) AS hit FROM orders),
e AS (SELECT count(*) AS n, count(*) FILTER (event_id % 5 <> 0 AND user_id IN (SELECT c_custkey FROM customer)) AS hit FROM events),
p AS (SELECT count(*) AS n FROM part),
t AS (SELECT unnest(['episode_poste', 'visite_sante_travail', 'conclusion_medicale', 'arret_travail', 'vaccination']) AS "table"),
u AS (SELECT unnest(['exposition_professionnelle', 'examen_complementaire', 'pathologie_atmp']) AS "table"),
s AS (SELECT unnest(['unite_travail', 'risque_unite_travail']) AS "table")
SELECT "table", 'travailleur_id' AS key_role, n AS attempted, kept AS resolved, n - kept AS missed FROM t, o
UNION ALL SELECT "table", 'travailleur_id', n, hit, n - hit FROM u, e
UNION ALL SELECT 'episode_poste', 'etablissement_id', kept, hit, kept - hit FROM o
UNION ALL SELECT "table", 'etablissement_id', n, n, 0 FROM s, p
""",
)
def table_run_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys looked up, found and missed, observed in the writes; a site only where the row is kept."""
    return run_of(spark, sf_dir).usage
