"""Given tables written as exports, landed from the files and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harmonia.session import ensure_checkpoint_dir
from harmonia.sources.artifacts import read_json_lines, read_tables, write_artifacts, write_csv, write_json_lines
from harmonia.sources.exports import Bronze
from suite import query
from suite.views import read, standard_tables


# Part files of an export at least, and bytes of text in one, so that a task's share does not grow with the table.
PARTS, PART_BYTES = 4, 64 << 20


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex}"


def _in_order(df: DataFrame, key: str) -> DataFrame:
    """Part files that follow one another in the order of ``key``, as many as the texts' bytes ask for."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    size = df.agg(F.sum(reduce(Column.__add__, texts)).alias("bytes")).first()["bytes"] if texts else None
    return df.repartitionByRange(max(PARTS, -(-(size or 0) // PART_BYTES)), key).sortWithinPartitions(key)


def write_raw_csv(df: DataFrame, key: str, cells: dict[str, Column], path: str, sep: str = ",") -> None:
    """A CSV export of cells that are written as they stand; each part file has the header."""
    head = F.when(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0, F.lit(sep.join(cells) + "\n")).otherwise("")
    line = F.concat(head, F.concat_ws(sep, *cells.values()))
    _in_order(df, key).select(line).write.text(path)


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def _landed(spark: SparkSession, folder: str) -> Bronze:
    return Bronze.land(spark, f"{folder}/exports", f"{folder}/bronze")


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


UNIX_LINES = r"replace(replace({}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


@query(
    "landed_documents",
    f"""
SELECT row_number() OVER (ORDER BY doc_id) AS ordinal, CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang,
       (n_chars % 30) || '" wide' AS width, length({UNIX_LINES.format("coalesce(text, '')")}) AS n_chars,
       sha256({UNIX_LINES.format("coalesce(text, '')")}) AS text_sha256, source || ', "' || lang || '"' AS place
FROM documents
""",
)
def landed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV export with line breaks in cells, quotes that open no cell, and blank lines, read split by split."""
    folder = _folder(spark)
    text = F.coalesce("text", F.lit(""))
    cells = {
        "doc_id": F.col("doc_id").cast("string"), "lang": F.coalesce("lang", F.lit("")),
        "width": F.concat((F.col("n_chars") % 30).cast("string"), F.lit('" wide')), "text": quoted(text),
        "place": F.concat(quoted(F.concat("source", F.lit(', "'), "lang", F.lit('"'))), F.when(F.col("doc_id") % 7 == 0, "\n\n").otherwise("")),
    }
    write_raw_csv(read(spark, sf_dir, "documents"), "doc_id", cells, f"{folder}/exports/documents.csv")
    table = _landed(spark, folder).read("documents.csv")
    return table.df.select(
        "ordinal", *(table.cell(c).alias(c) for c in ("doc_id", "lang", "width", "place")),
        F.length(table.cell("text")).cast("long").alias("n_chars"), _digest(table.cell("text")).alias("text_sha256"),
    )


@query(
    "landed_orders",
    """
SELECT row_number() OVER (ORDER BY o_orderkey) AS ordinal, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate
FROM orders
""",
)
def landed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A semicolon export of several part files, each with its header."""
    folder = _folder(spark)
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate")
    )
    _in_order(orders, "o_orderkey").write.option("header", True).option("sep", ";").csv(f"{folder}/exports/orders.csv")
    table = _landed(spark, folder).read("orders.csv")
    return table.df.select("ordinal", *(table.cell(c).alias(c) for c in table.columns))


LATIN = "regexp_replace(coalesce(text, ''), '[^\\x{20}-\\x{7E}\\x{A0}-\\x{FF}]', '?', 'g')"


@query(
    "landed_encodings",
    f"""
SELECT 'latin' AS encoding, row_number() OVER (ORDER BY doc_id) AS ordinal, CAST(doc_id AS VARCHAR) AS doc_id, sha256({LATIN}) AS text_sha256 FROM documents
UNION ALL SELECT 'utf8', row_number() OVER (ORDER BY doc_id), CAST(doc_id AS VARCHAR), sha256({LATIN}) FROM documents
""",
)
def landed_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same export in two encodings: bytes outside ASCII are Windows-1252 where they are not UTF-8."""
    folder = _folder(spark)
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7E\xA0-\xFF]", "?").alias("text")
    docs = _in_order(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", text)
    for name, encoding in (("latin", "ISO-8859-1"), ("utf8", "UTF-8")):
        docs.write.options(header=True, sep="|", escape='"', encoding=encoding).csv(f"{folder}/exports/{name}.csv")
    bronze = _landed(spark, folder)
    found = None
    for name in ("latin", "utf8"):
        table = bronze.read(f"{name}.csv")
        rows = table.df.select(
            F.lit(name).alias("encoding"), "ordinal", table.cell("doc_id").alias("doc_id"), _digest(table.cell("text")).alias("text_sha256")
        )
        found = rows if found is None else found.unionByName(rows)
    return found


@query(
    "landed_catalogue",
    """
SELECT 'customer.csv' AS source_ref, 'csv' AS format, 0 AS position, 'c_custkey,c_mktsegment,c_name' AS columns, count(*) AS row_count, max(c_name) AS last_value FROM customer
UNION ALL SELECT 'nation.parquet', 'parquet', 1, 'n_name,n_nationkey', count(*), CAST(max_by(n_nationkey, n_nationkey) AS VARCHAR) FROM nation
UNION ALL SELECT 'part.CSV', 'csv', 2, 'p_brand,p_partkey,p_type', count(*), max_by(p_type, p_partkey) FROM part
""",
)
def landed_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of a folder in listing order, with their columns, rows and the last cell of the last row."""
    folder = _folder(spark)
    exports = f"{folder}/exports"
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    _in_order(customer, "c_custkey").write.options(header=True, sep="\t").csv(f"{exports}/customer.csv")
    _in_order(read(spark, sf_dir, "nation").select("n_name", "n_nationkey"), "n_nationkey").write.parquet(f"{exports}/nation.parquet")
    part = read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_type")
    _in_order(part, "p_partkey").write.options(header=True, sep="|").csv(f"{exports}/part.CSV")
    read(spark, sf_dir, "region").write.json(f"{exports}/region.json")
    found = None
    for position, (ref, table) in enumerate(_landed(spark, folder).sources().items()):
        rows = table.df.agg(F.count("*").alias("row_count"), F.max_by(table.cell(table.columns[-1]), "ordinal").alias("last_value")).select(
            F.lit(ref).alias("source_ref"), F.lit(table.format).alias("format"), F.lit(position).alias("position"),
            F.lit(",".join(table.columns)).alias("columns"), "row_count", "last_value",
        )
        found = rows if found is None else found.unionByName(rows)
    return found


# --- artefacts ------------------------------------------------------------------------------------------
@query(
    "stored_tables",
    """
SELECT 'travailleur' AS name, count(*) AS row_count, count(DISTINCT c_mktsegment) AS kinds FROM customer
UNION ALL SELECT 'visite_sante_travail', count(*), count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'vaccination', 0, 0
""",
)
def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard tables written and read by name: an empty one keeps its columns, an absent one is left out."""
    made = standard_tables(spark, sf_dir, ["travailleur", "visite_sante_travail"])
    empty = made["visite_sante_travail"].where("false")
    folder = f"{_folder(spark)}/tables"
    write_artifacts({**made, "vaccination": empty}, folder)
    found = None
    for name, df in read_tables(spark, folder, [*made, "vaccination", "arret_travail"]).items():
        kind = "suivi_type_concept_id" if name == "travailleur" else "type_visite_concept_id"
        row = df.agg(F.count("*").alias("row_count"), F.count_distinct(kind).alias("kinds")).select(F.lit(name).alias("name"), "*")
        found = row if found is None else found.unionByName(row)
    return found


@query(
    "stored_texts",
    f"""
SELECT 'csv' AS format, CAST(doc_id AS VARCHAR) AS doc_id, CAST(n_chars > 500 AS VARCHAR) AS long, sha256(coalesce(text, '')) AS text_sha256 FROM documents
UNION ALL SELECT 'json', CAST(doc_id AS VARCHAR), CAST(n_chars > 500 AS VARCHAR), sha256(coalesce(text, '')) FROM documents
""",
)
def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents written as delimited text and as JSON lines, and read back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).alias("long"), F.coalesce("text", F.lit("")).alias("text"))
    folder = _folder(spark)
    write_csv(docs, f"{folder}/csv")
    write_json_lines(docs, f"{folder}/json")
    read_csv = spark.read.csv(f"{folder}/csv", header=True, multiLine=True, escape="\\")
    read_json = read_json_lines(spark, f"{folder}/json", "doc_id long, long boolean, text string")
    found = None
    for name, df in (("csv", read_csv), ("json", read_json)):
        rows = df.select(
            F.lit(name).alias("format"), F.col("doc_id").cast("string").alias("doc_id"), F.col("long").cast("string").alias("long"),
            F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        )
        found = rows if found is None else found.unionByName(rows)
    return found
