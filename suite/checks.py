"""Quality checks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonia.operators import disclosure, quality
from suite import query
from suite.scalars import SPARK_PHRASE
from suite.sqltext import norm
from suite.views import read

SHIPMENTS_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS date_debut, CAST(l_shipdate AS DATE) AS date_fin
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").cast("string").alias("id"),
        F.col("o_orderdate").cast("date").alias("date_debut"), F.col("l_shipdate").cast("date").alias("date_fin"),
    )


@query(
    "referential_gaps",
    "SELECT user_id, count(*) AS n FROM events WHERE NOT EXISTS "
    "(SELECT 1 FROM supplier WHERE s_suppkey = user_id) GROUP BY 1",
)
def referential_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dangling_rows(read(spark, sf_dir, "events"), "user_id", read(spark, sf_dir, "supplier"), "s_suppkey")


@query("duplicate_ids", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(read(spark, sf_dir, "lineitem"), "l_suppkey")


@query("temporal_coherence", f"SELECT * FROM ({SHIPMENTS_SQL}) WHERE date_fin < date_debut")
def temporal_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.incoherent_dates(shipments(spark, sf_dir))


def exposure_sql(phrase: str) -> str:
    n = norm(phrase)
    words = " OR ".join(f"contains({n}, '{w}')" for w in ("bois", "chim", "poussiere", "manutention", "repetitif", "gestes"))
    return f"({words})"


@query(
    "unknown_values",
    f"SELECT source_value, count(*) AS n FROM (SELECT {SPARK_PHRASE} AS source_value FROM orders) "
    f"WHERE NOT {exposure_sql('source_value')} GROUP BY 1",
)
def unknown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = read(spark, sf_dir, "orders").select(F.expr(SPARK_PHRASE).alias("phrase"))
    return quality.unknown_values(phrases, "phrase", "normalize_exposure").select("source_value", "n")


@query(
    "unknown_rate",
    f"SELECT count(*) AS rows, count(*) FILTER (NOT {exposure_sql('p')}) AS unknown_rows, "
    f"round_even(count(*) FILTER (NOT {exposure_sql('p')}) / count(*), 4) AS unknown_rate "
    f"FROM (SELECT {SPARK_PHRASE} AS p FROM orders)",
)
def unknown_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = read(spark, sf_dir, "orders").select(F.expr(SPARK_PHRASE).alias("phrase"))
    return quality.unknown_rate(phrases, "phrase", "normalize_exposure")


@query(
    "row_loss",
    """
SELECT 'visits' AS "table", (SELECT count(*) FROM orders) AS source_rows, count(*) AS target_rows,
       (SELECT count(*) FROM orders) - count(*) AS lost_rows FROM orders WHERE o_orderstatus <> 'P'
UNION ALL
SELECT 'conclusions', (SELECT count(*) FROM lineitem), count(*), (SELECT count(*) FROM lineitem) - count(*)
FROM lineitem WHERE l_discount > 0
""",
)
def row_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return quality.row_loss(
        {"visits": orders, "conclusions": items},
        {"visits": orders.where("o_orderstatus <> 'P'"), "conclusions": items.where("l_discount > 0")},
    )


@query(
    "anomaly_table",
    f"""
WITH s AS ({SHIPMENTS_SQL})
SELECT 'duplicate_id' AS rule, 'shipments' AS "table", id AS record_id, count(*) || ' rows' AS detail FROM s GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'dates_out_of_order', 'shipments', id, CAST(date_debut AS VARCHAR) || ' > ' || CAST(date_fin AS VARCHAR)
FROM s WHERE date_fin < date_debut
""",
)
def anomaly_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.anomalies({"shipments": shipments(spark, sf_dir)}, {"shipments": "id"})


@query(
    "coverage_rules",
    """
WITH v AS (SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey)) AS n FROM orders),
x AS (SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id)) AS n FROM events),
e AS (SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)) AS n FROM lineitem),
r AS (SELECT 0 AS ord, 'visite_sante_travail' AS t, n FROM v UNION ALL SELECT 1, 'exposition_professionnelle', n FROM x
      UNION ALL SELECT 2, 'episode_poste', n FROM e)
SELECT ord, 'join_coverage:' || t || '.travailleur_id' AS rule, CASE WHEN n > 0 THEN 'alerte' ELSE 'info' END AS severity,
       CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status,
       CASE WHEN n > 0 THEN n || ' worker ids are missing from table travailleur.' ELSE 'All referenced workers exist.' END AS message
FROM r
""",
)
def coverage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    def worker(table: str, column: str) -> DataFrame:
        return read(spark, sf_dir, table).select(F.col(column).alias("travailleur_id"))

    tables = {
        "travailleur": worker("supplier", "s_suppkey"), "visite_sante_travail": worker("orders", "o_custkey"),
        "exposition_professionnelle": worker("events", "user_id"), "episode_poste": worker("lineitem", "l_suppkey"),
    }
    return quality.union_rules(quality.worker_coverage(tables))


# --- small cells -------------------------------------------------------------------------------------
# Nations by priority of the open orders: a few records a cell at the small scales.
SMALL_CELL = 5


@query(
    "small_cells",
    f"""
WITH rec AS (SELECT n_name AS r, o_orderpriority AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
             WHERE o_orderstatus = 'P' AND o_orderkey % 5 = 0),
held AS (SELECT r, c, count(*) AS n FROM rec GROUP BY 1, 2),
totals AS (SELECT r, sum(n) AS total FROM held GROUP BY 1),
cells AS (SELECT t.r, x.c, coalesce(n, 0) AS n, total FROM totals t CROSS JOIN (SELECT DISTINCT c FROM held) x LEFT JOIN held ON held.r = t.r AND held.c = x.c),
patterns AS (SELECT r, list(c ORDER BY c) AS cs FROM cells WHERE n BETWEEN 1 AND {SMALL_CELL - 1} GROUP BY 1),
alike AS (SELECT *, count(*) OVER (PARTITION BY cs) AS same FROM patterns),
lonely AS (SELECT *, count(*) OVER (PARTITION BY cs[1]) AS firsts FROM alike WHERE same = 1),
rest AS (SELECT r, cs FROM lonely WHERE firsts = 1),
partner AS (SELECT 'rest' AS g, r, CAST([] AS VARCHAR[]) AS cs FROM totals WHERE r NOT IN (SELECT r FROM rest) AND (SELECT count(*) FROM rest) = 1
            ORDER BY total, r LIMIT 1),
groups AS (SELECT 'p' || array_to_string(cs, '|') AS g, r, cs FROM alike WHERE same > 1
           UNION ALL SELECT 'f' || cs[1], r, cs FROM lonely WHERE firsts > 1
           UNION ALL SELECT 'rest', r, cs FROM rest UNION ALL SELECT * FROM partner),
shown AS (SELECT DISTINCT g, unnest(cs) AS c FROM groups),
narrow AS (SELECT g, min(c) AS own FROM shown GROUP BY 1 HAVING count(*) = 1),
more AS (SELECT g, c FROM (SELECT g, c, row_number() OVER (PARTITION BY g ORDER BY sum(n), c) AS k
         FROM groups JOIN narrow USING (g) JOIN cells USING (r) WHERE c <> own GROUP BY 1, 2) WHERE k = 1),
hidden AS (SELECT DISTINCT r, c FROM groups JOIN (SELECT * FROM shown UNION SELECT * FROM more) USING (g))
SELECT cells.r AS row_name, cells.c AS column_name, CASE WHEN hidden.r IS NULL THEN n END AS n, hidden.r IS NOT NULL AS suppressed,
       CASE WHEN n BETWEEN 1 AND {SMALL_CELL - 1} THEN 'small' WHEN hidden.r IS NOT NULL THEN 'complementary' END AS reason
FROM cells LEFT JOIN hidden ON hidden.r = cells.r AND hidden.c = cells.c
""",
)
def small_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_orderkey % 5 = 0")
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    records = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return disclosure.hide_small_cells(records, "n_name", "o_orderpriority", SMALL_CELL)
