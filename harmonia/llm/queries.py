"""Registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harmonia.llm import (
    decontamination, divergence, exact_dedup, language, near_dedup, packing, pii, quality, resampling, sharding, substring_dedup,
    token_counts, token_files,
)
from harmonia.llm.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), f"{Scratch(spark, 'sharding').root}/slot-map")


@query(
    "op2_decontamination",
    f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER.format('text')}, '{ALPHANUMERIC}') AS w FROM benchmark),
docs AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '{ALPHANUMERIC}') AS w FROM documents),
sized AS (SELECT *, least(10, len(w)) AS m FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT m FROM windows),
spans AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
          FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, sizes WHERE len(w) >= m)),
found AS (SELECT doc_id, i, m, item_id FROM spans JOIN windows USING (m, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY 1),
seen AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids, list(item_id ORDER BY item_id) AS item_ids
         FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN seen USING (doc_id)
""",
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids", "text_key")


@query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Position of each match: what lies between matches, and the matches before.  Kinds that look around themselves
# match one character more on either side in SQL, which is taken off again.
def _spans_sql(k: int, kind: str, pattern: str, confirm: str, around: str = "", context: str = "") -> str:
    low = f"CASE WHEN regexp_matches(m, '^{around}') THEN 1 ELSE 0 END" if around else "0"
    high = f"CASE WHEN regexp_matches(m, '{around}$') THEN 1 ELSE 0 END" if around else "0"
    sides = ("substr(t, greatest(start - 39, 1), least(start, 40))", "substr(t, stop + 1, 40)")
    near = "AND (" + " OR ".join(f"regexp_matches(lower({side}), '{context}')" for side in sides) + ")" if context else ""
    return f"""
SELECT doc_id, {k} AS k, '{kind}' AS kind, start, stop FROM (
  SELECT doc_id, t, stop - length(m) + {low} AS start, stop - {high} AS stop, trim(m, '"'' ,;:()') AS m,
         regexp_replace(m, '[^0-9]', '', 'g') AS d FROM (
    SELECT *, CAST(sum(gap + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM (
      SELECT doc_id, t, unnest(m) AS m, unnest(list_transform(s[1:len(m)], lambda x: length(x))) AS gap,
             unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT *, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS s FROM docs)
      WHERE len(m) > 0)))
WHERE {confirm} {near}"""


_LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i:
  (CASE WHEN i % 2 = 1 THEN CAST(substr(d, length(d) - i + 1, 1) AS INT)
        ELSE CAST(substr('0246813579', CAST(substr(d, length(d) - i + 1, 1) AS INT) + 1, 1) AS INT) END))) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0, list_transform(
  range(1, length(replace(m, ' ', '')) + 1), lambda i: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    substr(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), CAST(i AS INT), 1)) - 1)),
  lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1"""
PII_SQL = "WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS (" + " UNION ALL ".join([
    _spans_sql(1, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _spans_sql(2, "ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
               "NOT list_contains(list_transform(string_split(m, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 999) > 255), true)"),
    _spans_sql(3, "card", r"[0-9](?:[\x20-]?[0-9])+", f"length(d) BETWEEN 13 AND 19 AND {_LUHN}"),
    _spans_sql(4, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
    _spans_sql(5, "iban", rf"(?:^|[^A-Za-z0-9])(?:{pii.IBAN_KNOWN}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})(?:[^A-Za-z0-9]|$)", _MOD97, "[^A-Za-z0-9]"),
    _spans_sql(6, "ssn", r"(?:^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?:[^0-9-]|$)", "true", "[^0-9-]",
               "ssn|social security|insurance|tax id"),
    _spans_sql(7, "secret", r"(?:^|[^A-Za-z0-9_])[A-Fa-f0-9]{32,128}(?:[^A-Za-z0-9_]|$)", "true", "[^A-Za-z0-9_]",
               "token|key|secret|password|passwd|credential"),
]) + """),
joined AS (SELECT doc_id, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card,
       count(*) FILTER (k = 4) AS n_phone, count(*) AS n_spans,
       string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) FILTER (k <= 4) AS base,
       string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS spans FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_spans, 0) AS n_spans FROM docs LEFT JOIN joined USING (doc_id)"""


@query("op5_pii", PII_SQL)
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op9_token_ids")
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_ids(table(spark, sf_dir, "documents"), f"{Scratch(spark, 'token-ids').root}/ids")


@query(
    "op10_near_dedup",
    f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '{NOT_SPACE}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
             FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = r),
parts AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs LEFT JOIN sizes USING (doc_id) JOIN parts USING (doc_id)
""",
)
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


# Checksums byte by byte over the distinct features; the table of single bytes comes from the reflected polynomial.
@query(
    "op11_resampling",
    f"""
WITH steps AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(1, 9)),
                 lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS step),
texts AS (SELECT true AS raw, doc_id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
words AS (SELECT raw, doc_id, regexp_extract_all({LOWER.format('text')}, '{ALPHANUMERIC}') AS w FROM texts),
features AS (
  SELECT raw, doc_id, unnest(w) AS g FROM words UNION ALL
  SELECT raw, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
buckets AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(g)),
                lambda i: ('0x' || substr(h, 2 * CAST(i AS INT) + 1, 2))::BIGINT)),
              lambda r, b: xor(r // 256, step[CAST(xor(r % 256, b) AS INT) + 1])), 4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT g, hex(encode(g)) AS h FROM features), steps),
counts AS (SELECT bucket, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM features JOIN buckets USING (g) GROUP BY 1),
totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (ss + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain
          FROM counts, totals),
sums AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS total
         FROM features JOIN buckets USING (g) JOIN gains USING (bucket) WHERE raw GROUP BY 1),
weighed AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features,
                   CAST(coalesce(floor(CAST(total AS DOUBLE) / n_features), 0) AS BIGINT) AS weight,
                   ('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT AS h
            FROM (SELECT * FROM words WHERE raw) d LEFT JOIN sums USING (doc_id)),
scored AS (SELECT doc_id, n_words, n_features, weight,
                  weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
""",
)
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op12_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
)
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"{Scratch(spark, 'digest-index').root}/index")
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"), index, "documents")
    index.close()
    return found


@query(
    "op13_divergence",
    f"""
WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
seen AS (SELECT i, lang, source, unnest(w) AS term FROM docs),
terms AS (SELECT lang, term, count(*) AS n FROM seen GROUP BY 1, 2 HAVING count(DISTINCT i) >= 30),
own AS (SELECT lang, source, term, count(*) AS n FROM seen JOIN terms USING (lang, term) GROUP BY 1, 2, 3),
pairs AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM terms GROUP BY 1),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM pairs LEFT JOIN own USING (lang, source) GROUP BY 1, 2),
cells AS (SELECT lang, source, term, coalesce(own.n, 0) AS n,
                 1 + 1000000000::HUGEINT * (coalesce(own.n, 0) + 5) // (t.total + 5 * v) AS p,
                 1 + 1000000000::HUGEINT * (terms.n + 5) // (langs.total + 5 * v) AS q
          FROM totals t JOIN langs USING (lang) JOIN terms USING (lang) LEFT JOIN own USING (lang, source, term)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
          FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM pairs a JOIN pairs b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM cells WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
""",
)
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))
