"""Profiles of the given tables, read as text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.operators import profiling, source_graph
from harmonia.sources.exports import SourceTable
from suite import query
from suite.views import read

# Table, its columns, and the expression that numbers its rows.
PROFILED = {
    "orders": (["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"], "o_orderkey"),
    "customer": (["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "c_custkey"),
    "part": (["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "p_partkey"),
    "supplier": (["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "s_suppkey"),
    "nation": (["n_nationkey", "n_name", "n_regionkey"], "n_nationkey"),
    "events": (["event_id", "ts", "user_id", "event_type", "value", "props"], "event_id"),
    "lineitem": (
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_returnflag", "l_linestatus", "l_shipdate"],
        "l_orderkey * 10 + l_linenumber",
    ),
}
# Numbers and times whose text Spark and SQL would write differently.
AMOUNTS = {
    "o_totalprice", "c_acctbal", "p_retailprice", "s_acctbal", "value", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
}
TIMES = {
    "o_orderdate": ("yyyy-MM-dd", "%Y-%m-%d"), "l_shipdate": ("yyyy-MM-dd", "%Y-%m-%d"),
    "ts": ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
}


def rendered(column: str):
    if column in AMOUNTS:
        return F.col(column).cast("decimal(18,2)").alias(column)
    return F.date_format(column, TIMES[column][0]).alias(column) if column in TIMES else F.col(column)


def rendered_sql(column: str) -> str:
    if column in AMOUNTS:
        return f"CAST(CAST({column} AS DECIMAL(18,2)) AS VARCHAR)"
    return f"strftime({column}, '{TIMES[column][1]}')" if column in TIMES else f"CAST({column} AS VARCHAR)"


def source(spark: SparkSession, sf_dir: str, name: str) -> SourceTable:
    columns, order = PROFILED[name]
    df = read(spark, sf_dir, name).select(*map(rendered, columns), F.expr(f"{order} + 1").alias("row_number"))
    table = SourceTable.from_dataframe(name, df, F.col("row_number"))
    return SourceTable(name, tuple(columns), table.df.select("ordinal", *[f"c_{i}" for i in range(len(columns))]), table.format)


def sources(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> list[SourceTable]:
    return [source(spark, sf_dir, name) for name in names or PROFILED]


def cells_sql(names: list[str]) -> str:
    """(source_ref, column, value, ordinal) of every profiled cell."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS source_ref, '{column}' AS column_name, {rendered_sql(column)} AS value, {order} + 1 AS ordinal FROM {name}"
        for name in names
        for columns, order in [PROFILED[name]]
        for column in columns
    )


def counts_sql(names: list[str]) -> str:
    return (
        f"WITH cells AS ({cells_sql(names)}), counts AS (SELECT source_ref, column_name, value, count(*) AS n, "
        "min(ordinal) AS first_ordinal FROM cells GROUP BY 1, 2, 3)"
    )


MAIN = ["orders", "customer", "part"]
ALL = list(PROFILED)


@query(
    "profile_columns",
    counts_sql(ALL)
    + """, tests AS (
SELECT source_ref, column_name, regexp_replace(lower(column_name), '[^a-z0-9]+', '', 'g') AS normalized,
       CAST(sum(n) AS BIGINT) AS row_count,
       round_even(CAST(sum(n) FILTER (trim(value) <> '') AS DOUBLE) / sum(n), 3) AS completeness,
       count(*) FILTER (value <> '') AS distinct_count,
       bool_and(regexp_matches(value, '^(19|20)[0-9]{2}$')) AS years,
       bool_and(TRY_CAST(value AS DOUBLE) IS NOT NULL) AS numbers,
       bool_and(regexp_matches(value, '^[0-9]{2,4}[a-zA-Z]?$')) AS codes,
       count(DISTINCT regexp_replace(lower(value), '[^a-z0-9]+', '', 'g')) AS distinct_normalized
FROM counts GROUP BY 1, 2),
places AS (SELECT *, row_number() OVER (PARTITION BY source_ref, column_name ORDER BY first_ordinal) AS f,
       row_number() OVER (PARTITION BY source_ref, column_name ORDER BY n DESC, first_ordinal) AS t,
       row_number() OVER (PARTITION BY source_ref, column_name ORDER BY value) AS s FROM counts WHERE value <> ''),
lists AS (SELECT source_ref, column_name, string_agg(value, '|' ORDER BY f) FILTER (f <= 3) AS examples,
       string_agg(value, '|' ORDER BY s) FILTER (s <= 20) AS value_sample,
       string_agg(value || ':' || n, '|' ORDER BY t) FILTER (t <= 8) AS top_values FROM places GROUP BY 1, 2)
SELECT source_ref, column_name, normalized, coalesce(examples, '') AS examples, coalesce(value_sample, '') AS value_sample,
       coalesce(top_values, '') AS top_values, row_count, completeness, distinct_count,
       CASE WHEN contains(normalized, 'date') OR contains(normalized, 'debut') OR contains(normalized, 'fin') THEN 'date'
            WHEN contains(normalized, 'id') AND distinct_count >= greatest(1, floor(row_count * 0.7)) THEN 'identifier'
            WHEN years THEN 'year' WHEN numbers THEN 'numeric' WHEN codes THEN 'code'
            WHEN distinct_normalized <= greatest(8, floor(row_count * 0.6)) THEN 'categorical' ELSE 'text' END AS inferred_type,
       CASE WHEN regexp_matches(normalized, '"""
    + "|".join(fixed.S4_COLUMN_TOKENS) + """') THEN 'S4'
            WHEN regexp_matches(normalized, '""" + "|".join(fixed.S2_COLUMN_TOKENS) + """') THEN 'S2'
            WHEN regexp_matches(source_ref || normalized, '""" + "|".join(fixed.S3_CONTEXT_TOKENS) + """') THEN 'S3'
            WHEN regexp_matches(source_ref || normalized, '""" + "|".join(fixed.S2_CONTEXT_TOKENS) + """') THEN 'S2' ELSE 'S1' END AS sensitivity
FROM tests LEFT JOIN lists USING (source_ref, column_name)
""",
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = sources(spark, sf_dir)
    columns = profiling.profile(spark, tables, profiling.value_counts(tables).written()).columns
    return columns.select(
        "source_ref", F.col("column").alias("column_name"), "normalized", "row_count", "completeness", "distinct_count",
        "inferred_type", "sensitivity", F.array_join("examples", "|").alias("examples"), F.array_join("value_sample", "|").alias("value_sample"),
        F.array_join(F.transform("top_values", lambda v: F.concat_ws(":", v["value"], v["count"].cast("string"))), "|").alias("top_values"),
    )


def ranked(spark: SparkSession, sf_dir: str, rank) -> DataFrame:
    tables = sources(spark, sf_dir, MAIN)
    names = F.create_map(
        *[F.lit(x) for i, t in enumerate(tables) for p, n in enumerate(t.columns) for x in (f"{i}.{p}", f"{t.source_ref}.{n}")]
    )
    found = rank(profiling.value_counts(tables).written())
    return found.select(
        F.element_at(names, F.concat_ws(".", F.col("source").cast("string"), F.col("position").cast("string"))).alias("column_name"),
        "rank", "value", F.col("n").alias("count"),
    )


def ranked_sql(order: str, limit: int) -> str:
    return (
        counts_sql(MAIN)
        + f""" SELECT source_ref || '.' || column_name AS column_name, rank, value, n AS count FROM (
        SELECT *, row_number() OVER (PARTITION BY source_ref, column_name ORDER BY {order}) AS rank
        FROM counts WHERE value <> '') WHERE rank <= {limit}"""
    )


@query("top_values", ranked_sql("n DESC, first_ordinal, value", 8))
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir, profiling.top_values)


@query("first_examples", ranked_sql("first_ordinal, value", 3))
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir, profiling.first_examples)


@query("value_sample", ranked_sql("value", 20))
def value_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir, profiling.value_sample)


@query(
    "column_statistics",
    counts_sql(ALL)
    + """ SELECT source_ref, CAST(sum(n) AS BIGINT) AS cells, count(DISTINCT column_name) AS columns, count(*) AS distinct_values
FROM counts GROUP BY 1""",
)
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = sources(spark, sf_dir)
    names = F.array(*[F.lit(t.source_ref) for t in tables])
    stats = profiling.column_statistics(profiling.value_counts(tables).written())
    return stats.groupBy(F.element_at(names, F.col("source") + 1).alias("source_ref")).agg(
        F.sum("row_count").alias("cells"), F.count("*").alias("columns"), F.sum("distinct_count").alias("distinct_values")
    )


# --- source graph ---------------------------------------------------------------------------
@query(
    "column_overlaps",
    counts_sql(ALL)
    + """ SELECT a.source_ref || '.' || a.column_name AS left_column, b.source_ref || '.' || b.column_name AS right_column,
       count(*) AS overlap
FROM counts a JOIN counts b ON a.value = b.value AND a.source_ref <> b.source_ref AND a.value <> ''
 AND list_position(['orders', 'customer', 'part', 'supplier', 'nation', 'events', 'lineitem'], a.source_ref)
   < list_position(['orders', 'customer', 'part', 'supplier', 'nation', 'events', 'lineitem'], b.source_ref)
GROUP BY 1, 2""",
)
def column_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = sources(spark, sf_dir)
    labels = F.create_map(
        *[F.lit(x) for i, t in enumerate(tables) for p, n in enumerate(t.columns) for x in (f"{i}.{p}", f"{t.source_ref}.{n}")]
    )

    def label(side: str):
        key = F.concat_ws(".", F.col(f"{side}.source").cast("string"), F.col(f"{side}.position").cast("string"))
        return F.element_at(labels, key).alias(f"{side}_column")

    ids = [(i, p) for i, t in enumerate(tables) for p in range(len(t.columns))]
    return source_graph.overlaps(source_graph.cell_values(tables), ids).select(label("left"), label("right"), "overlap")


WANTED = [("c_nationkey", "n_nationkey"), ("o_custkey", "c_custkey"), ("p_size", "l_linenumber")]


@query(
    "overlap_values",
    " UNION ALL ".join(
        f"SELECT '{a}' AS left_column, '{b}' AS right_column, value FROM (SELECT CAST({a} AS VARCHAR) AS value FROM {left} "
        f"INTERSECT SELECT CAST({b} AS VARCHAR) FROM {right}) WHERE value <> ''"
        for a, b in WANTED
        for left in PROFILED if a in PROFILED[left][0]
        for right in PROFILED if b in PROFILED[right][0]
    ),
)
def overlap_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values that both columns hold, not those of a sample."""
    tables = sources(spark, sf_dir, [n for n in PROFILED if any(c in PROFILED[n][0] for pair in WANTED for c in pair)])
    place = {n: (i, p) for i, t in enumerate(tables) for p, n in enumerate(t.columns)}
    struct = "struct<source:int,position:int>"
    pairs = spark.createDataFrame(
        [(place[a], place[b], a, b) for a, b in WANTED], f"left {struct}, right {struct}, left_column string, right_column string"
    )
    found = source_graph.shared_values(source_graph.distinct_values(profiling.value_counts(tables)), pairs)
    return found.join(pairs, ["left", "right"]).select("left_column", "right_column", "value")


@query(
    "key_uniqueness",
    """
WITH k AS (
  SELECT 'orders.o_custkey' AS c, count(DISTINCT o_custkey) AS d, count(*) AS n FROM orders
  UNION ALL SELECT 'orders.o_orderkey', count(DISTINCT o_orderkey), count(*) FROM orders
  UNION ALL SELECT 'customer.c_custkey', count(DISTINCT c_custkey), count(*) FROM customer
  UNION ALL SELECT 'customer.c_nationkey', count(DISTINCT c_nationkey), count(*) FROM customer)
SELECT c AS column_name, round_even(d / n, 3) AS uniqueness_ratio, d / n >= 0.98 AS is_unique FROM k
""",
)
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harmonia.functions.matching import uniqueness_ratio

    tables = [
        SourceTable.from_dataframe(name, read(spark, sf_dir, name).select(*columns), F.col(order) + 1)
        for name, columns, order in (
            ("orders", ["o_custkey", "o_orderkey"], "o_orderkey"), ("customer", ["c_custkey", "c_nationkey"], "c_custkey"),
        )
    ]
    names = F.create_map(
        *[F.lit(x) for i, t in enumerate(tables) for p, n in enumerate(t.columns) for x in (f"{i}.{p}", f"{t.source_ref}.{n}")]
    )
    stats = profiling.column_statistics(profiling.value_counts(tables).written())
    ratio = uniqueness_ratio(F.col("distinct_count"), F.col("row_count"))
    return stats.select(
        F.element_at(names, F.concat_ws(".", F.col("source").cast("string"), F.col("position").cast("string"))).alias("column_name"),
        ratio.alias("uniqueness_ratio"), (ratio >= 0.98).alias("is_unique"),
    )
