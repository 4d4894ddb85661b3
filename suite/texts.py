"""The n-gram classifier over whole documents: language from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonia.operators import matching, profiling, text_model, text_vectors
from harmonia.plans.mapping_document import assemble
from harmonia.session import cut_lineage, written
from suite import query
from suite.profiles import sources
from suite.sqltext import norm
from suite.views import read

NO_RULES = "left struct<source_ref:string>, right struct<source_ref:string>, status string, confidence_score double"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("record_id"), F.col("lang").alias("expected"), "text"
    )


def learned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, text_vectors.TextModel]:
    """Documents, their texts and the model."""
    docs = documents(spark, sf_dir)
    rows = text_vectors.texts(docs, "text", "expected")
    return docs, rows, text_vectors.train(docs, rows)


# SQL cuts texts into pieces of 200 characters with an overlap of four, then every
# piece into n-grams: positions in a short text are cheap.
GRAMS = " UNION ALL ".join(
    f"SELECT doc_id, lang, substr(c, i, {n}) AS g FROM "
    f"(SELECT *, unnest(range(1, least(200, length(c) - {n - 1}) + 1)) AS i FROM pieces)"
    for n in (3, 4, 5)
)
COUNTS_SQL = f"""
WITH docs AS (SELECT doc_id, lang, {norm('text')} AS t FROM documents),
pieces AS (SELECT doc_id, lang, substr(t, k * 200 + 1, 204) AS c
           FROM (SELECT *, unnest(range(0, (length(t) + 199) // 200)) AS k FROM docs WHERE length(t) >= 3)),
grams AS ({GRAMS}),
tokens AS (
  SELECT doc_id, lang, 'text:ngram:' || g AS token FROM grams
  UNION ALL SELECT doc_id, lang, 'text:ngram:' || t FROM docs WHERE length(t) BETWEEN 1 AND 2
  UNION ALL SELECT doc_id, lang, 'text:' || t FROM docs WHERE t <> ''),
counts AS (SELECT doc_id, lang, token, count(*) AS n FROM tokens GROUP BY 1, 2, 3),
idf AS (SELECT token, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1.0, 6) AS idf
        FROM counts GROUP BY 1)"""
VECTORS_SQL = COUNTS_SQL + """,
raw AS (SELECT doc_id, lang, token, n * idf AS w FROM counts JOIN idf USING (token)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1),
vectors AS (SELECT doc_id, lang, token, round(w / norm, 8) AS weight FROM raw JOIN norms USING (doc_id))"""
MODEL_SQL = VECTORS_SQL + """,
sizes AS (SELECT lang, count(*) AS k FROM documents GROUP BY 1),
means AS (SELECT v.lang, token, sum(weight) / max(k) AS m FROM vectors v JOIN sizes USING (lang) GROUP BY 1, 2),
lengths AS (SELECT lang, sqrt(sum(m * m)) AS len FROM means GROUP BY 1),
centroids AS (SELECT lang AS label, token, round(m / len, 8) AS c FROM means JOIN lengths USING (lang))"""
SCORES_SQL = MODEL_SQL + """,
dots AS (SELECT doc_id, label, round(sum(weight * c), 6) AS score FROM vectors JOIN centroids USING (token) GROUP BY 1, 2),
scores AS (SELECT d.doc_id, d.lang, s.lang AS label, coalesce(score, 0.0) AS score
           FROM documents d CROSS JOIN sizes s LEFT JOIN dots ON dots.doc_id = d.doc_id AND dots.label = s.lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rank FROM scores)"""


@query(
    "ngram_counts",
    COUNTS_SQL + " SELECT doc_id, count(*) AS tokens, CAST(sum(n) AS BIGINT) AS occurrences, max(n) AS most FROM counts GROUP BY 1",
)
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = text_vectors.packed_counts(documents(spark, sf_dir), "text")
    # The text itself is a token too, found once.
    return packed.select(
        F.col("record_id").alias("doc_id"), (F.size("codes") + 1).cast("bigint").alias("tokens"),
        (F.aggregate("n", F.lit(0).cast("bigint"), lambda total, n: total + n) + 1).alias("occurrences"),
        F.coalesce(F.array_max("n"), F.lit(1)).cast("bigint").alias("most"),
    )


@query("document_frequency", COUNTS_SQL + " SELECT df, idf, count(*) AS tokens FROM idf GROUP BY 1, 2")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text_vectors.frequency_of_texts(documents(spark, sf_dir), "text")
    return tokens.groupBy("df", "idf").agg(F.count("*").alias("tokens"))


@query(
    "tfidf_vectors",
    VECTORS_SQL + """ SELECT doc_id, count(*) AS tokens, round(sum(weight), 4) AS total, round(max(weight), 6) AS heaviest,
       round(sqrt(sum(weight * weight)), 5) AS length FROM vectors GROUP BY 1""",
)
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = text_vectors.texts(docs, "text")
    tokens = written(text_vectors.document_frequency(rows, docs.count()))
    weight = F.col("weight")
    found = text_vectors.Weighed(rows, tokens).vectors().select("record_id", F.explode("weights").alias("weight"))
    return found.groupBy(F.col("record_id").alias("doc_id")).agg(
        F.count("*").alias("tokens"), F.round(F.sum(weight), 4).alias("total"), F.round(F.max(weight), 6).alias("heaviest"),
        F.round(F.sqrt(F.sum(weight * weight)), 5).alias("length"),
    )


@query(
    "centroid_train",
    MODEL_SQL + """ SELECT label, count(*) AS tokens, round(sum(c), 3) AS total, round(max(c), 6) AS heaviest,
       round(sqrt(sum(c * c)), 5) AS length FROM centroids GROUP BY 1""",
)
def centroid_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.col("weight")
    return learned(spark, sf_dir)[2].centroids.groupBy("label").agg(
        F.count("*").alias("tokens"), F.round(F.sum(weight), 3).alias("total"), F.round(F.max(weight), 6).alias("heaviest"),
        F.round(F.sqrt(F.sum(weight * weight)), 5).alias("length"),
    )


@query("centroid_predict", SCORES_SQL + " SELECT doc_id, rank, label, score FROM ranked WHERE rank <= 3")
def centroid_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows, model = learned(spark, sf_dir)
    found = text_vectors.predict(docs, rows, model, 3)
    return found.select(
        F.col("record_id").alias("doc_id"), F.col("rank").cast("bigint").alias("rank"), "label", "score"
    )


@query(
    "centroid_evaluate",
    SCORES_SQL + """ SELECT count(DISTINCT doc_id) AS examples_count,
       round_even(count(*) FILTER (rank = 1 AND label = lang) / count(DISTINCT doc_id), 4) AS top1_accuracy,
       round_even(count(*) FILTER (rank <= 3 AND label = lang) / count(DISTINCT doc_id), 4) AS topk_accuracy,
       0.0 AS blocked_s4_recall, CAST(0 AS BIGINT) AS blocked_s4_examples FROM ranked""",
)
def centroid_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows, model = learned(spark, sf_dir)
    predicted = text_vectors.predict(docs, rows, model, 3, "expected")
    return text_model.evaluate(predicted, 3)


# --- records and suggestions over the profiled columns -----------------------------------------------
def mapped_catalogue(spark: SparkSession, sf_dir: str):
    """Profiles of the given tables and the mapping that follows from them."""
    profiles = profiling.profile(spark, sources(spark, sf_dir))
    columns = cut_lineage(profiles.columns)
    held = cut_lineage(
        profiles.sources.withColumn(
            "inferred_entities",
            F.when(F.col("source_ref").isin("orders", "events"), F.array(F.lit("visite_sante_travail"), F.lit("arret_travail")))
            .otherwise(F.array(F.lit("travailleur"), F.lit("entreprise"))),
        )
    )
    profiles = profiling.Profiles(columns, held)
    # Everything proposed counts as approved, so that the records hold every field.
    proposals = cut_lineage(matching.propose_mappings(columns, held).withColumn("status", F.lit("auto_validable")))
    none = spark.createDataFrame([], NO_RULES)
    mapping = assemble(
        profiles, proposals, matching.blocked_columns(columns), none, none, source_system="suite", schema_version="v0"
    )
    return profiles, mapping


@query("learning_dataset")
def learning_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles, mapping = mapped_catalogue(spark, sf_dir)
    records = text_model.learning_records(mapping, profiles.columns)
    return records.select("task", "label", "source_ref", "source_column", "target", "source_value", "target_value", "review_status")


@query("suggestions")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles, mapping = mapped_catalogue(spark, sf_dir)
    records = cut_lineage(text_model.column_records(text_model.learning_records(mapping, profiles.columns)))
    features = text_model.token_counts(records, text_model.column_features(), "expected")
    model = text_model.train(records, features, materialize=True)
    found = text_model.suggest(profiles.columns, profiles.sources, model, min_score=0.2)
    return found.select("source_ref", "source_column", "candidate_entity", "rank", "target", "score", "status")
