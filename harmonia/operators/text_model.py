"""Nearest-centroid classifier over TF-IDF character n-grams of records with several features.

A vector is rows of (record, token, weight): records are the columns of a
catalogue, short and with weighted features of several kinds.  Whole texts are
packed instead (`text_vectors`).  Tokens are joined with the model, which has one
row per token, and common tokens are salted by their known document frequency.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.functions.matching import target_type_compatible
from harmonia.functions.ngrams import weighted_list_tokens, weighted_tokens
from harmonia.functions.text import normalize, text
from harmonia.functions.values import suggestion_status, value_mapping_label
from harmonia.operators.matching import target_fields
from harmonia.operators.skew import hot_counts, join_unique
from harmonia.plans.mapping_document import Mapping
from harmonia.session import written

ID = "record_id"

RECORD_SCHEMA = (
    "task string, label string, source_system string, schema_version string, mapping_version string, "
    "source_ref string, source_column string, source_column_normalized string, source_type string, "
    "source_sensitivity string, source_examples array<string>, source_top_values array<struct<value:string,count:bigint>>, "
    "entity string, target_field string, target string, transform string, confidence_score double, "
    "review_status string, blocked_reason string, recommended_action string, source_value string, "
    "target_value string, count bigint"
)


# --- learning records ----------------------------------------------------------------------
def learning_records(mapping: Mapping, columns: DataFrame) -> DataFrame:
    """Mapped columns, blocked columns and mapped values of a reviewed mapping as examples."""
    profiled = columns.select(
        "source_ref", F.col("column").alias("source_column"),
        F.col("normalized").alias("source_column_normalized"), F.col("inferred_type").alias("source_type"),
        F.col("sensitivity").alias("source_sensitivity"), F.col("examples").alias("source_examples"),
        F.col("top_values").alias("source_top_values"),
    )
    target = F.concat_ws(".", "entity", "target_field").alias("target")
    mapped = mapping.fields.join(profiled, ["source_ref", "source_column"], "left").select(
        F.lit("column_mapping").alias("task"), F.lit("positive").alias("label"), "source_ref", "source_column",
        "source_column_normalized", "source_type", "source_sensitivity", "source_examples", "source_top_values",
        "entity", "target_field", target, "transform", "confidence_score", "review_status",
    )
    blocked = (
        mapping.blocked.join(profiled.drop("source_sensitivity"), ["source_ref", "source_column"], "left")
        .select(
            F.lit("column_mapping").alias("task"), F.lit("blocked_s4").alias("label"), "source_ref", "source_column",
            "source_column_normalized", "source_type", F.col("sensitivity").alias("source_sensitivity"),
            "source_examples", "source_top_values", F.lit("blocked_s4").alias("review_status"),
            F.col("reason").alias("blocked_reason"), "recommended_action",
        )
    )
    values = mapping.value_items.select(
        F.lit("value_mapping").alias("task"), value_mapping_label(F.col("status")).alias("label"), "source_ref",
        "source_column", "entity", "target_field", target, "transform", "source_value", "target_value", "count",
        F.col("status").alias("review_status"),
    )
    records = mapped.unionByName(blocked, allowMissingColumns=True).unionByName(values, allowMissingColumns=True)
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    versions = {
        "source_system": F.lit(mapping.source_system), "schema_version": F.lit(mapping.schema_version),
        "mapping_version": F.lit(mapping.mapping_version),
    }
    return records.select(*[versions[n].alias(n) if n in versions else F.col(n) for n in names])


def dataset_summary(records: DataFrame) -> DataFrame:
    """Records by task and label."""
    return records.groupBy("task", "label").agg(F.count("*").alias("records_count"))


def model_label(label: Column, target: Column) -> Column:
    return F.when(label == "blocked_s4", fixed.BLOCKED_LABEL).otherwise(text(target))


def column_features() -> Column:
    """Weighted tokens of a column record."""
    weight = fixed.FEATURE_WEIGHTS
    stem = F.regexp_replace(F.regexp_extract("source_ref", "([^/]*)$", 1), "(?<=.)\\.[^.]*$", "")
    name = F.coalesce(F.nullif(F.col("source_column_normalized"), F.lit("")), normalize(text(F.col("source_column"))))
    file = normalize(text(stem))
    examples = F.transform("source_examples", normalize)
    values = F.transform("source_top_values", lambda item: normalize(item["value"]))
    return F.concat(
        weighted_tokens("file", file, weight["file"], file),
        weighted_tokens("column", name, weight["column"], name),
        weighted_tokens("type", text(F.col("source_type")), weight["type"]),
        weighted_tokens("sensitivity", text(F.col("source_sensitivity")), weight["sensitivity"]),
        weighted_tokens("entity", text(F.col("entity")), weight["entity"]),
        weighted_tokens("transform", text(F.col("transform")), weight["transform"]),
        weighted_list_tokens("example", examples, weight["example"]),
        weighted_list_tokens("value", values, weight["value"]),
    )


def column_records(records: DataFrame) -> DataFrame:
    """Column examples with an id and the label to learn."""
    return records.where("task = 'column_mapping'").select(
        F.concat_ws("|", "source_ref", "source_column", text(F.col("entity")), text(F.col("target_field"))).alias(ID),
        model_label(F.col("label"), F.col("target")).alias("expected"), "*",
    )


# --- counts and vectors ------------------------------------------------------------------------
def _spread(records: DataFrame) -> DataFrame:
    """Records shuffled by id before they grow into tokens.

    The number of partitions is given, since AQE would merge them by the size of
    the texts, not of the tokens they become.
    """
    partitions = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return records.repartition(partitions, ID)


def token_counts(records: DataFrame, features: Column, *keep: str) -> DataFrame:
    """(record_id, kept columns, token, n): weighted token counts of records with several features."""
    exploded = _spread(records).select(ID, *keep, F.explode(features).alias("_f"))
    return exploded.groupBy(ID, *keep, F.col("_f.token").alias("token")).agg(F.sum("_f.weight").alias("n"))


def document_frequency(counts: DataFrame, examples: Column) -> DataFrame:
    """(token, df, idf); ``examples`` is the number of records."""
    frequency = counts.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.round(F.log((examples + F.lit(1)) / (F.col("df") + F.lit(1))) + F.lit(1.0), 6)
    return frequency.select("token", "df", idf.alias("idf"))


def vectors(counts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Counts with their weight: tf times idf over the record's length, 8 digits, zeros dropped.

    Tokens that the model does not know are left out.  ``tokens`` is read three
    times here, so it should be a written or checkpointed table.
    """
    joined = join_unique(counts, tokens.drop("df"), "token", "inner", hot=hot_counts(tokens, "token", "df"))
    raw = F.col("n") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(ID)))
    return joined.withColumn("weight", F.round(raw / norm, 8)).where(raw != 0)


# --- model ---------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Model:
    """``tokens``: token, df, idf, centroids (label, weight).  ``labels``: label, examples_count."""

    tokens: DataFrame
    labels: DataFrame

    def save(self, folder: str) -> None:
        self.tokens.write.mode("overwrite").parquet(f"{folder}/tokens")
        self.labels.write.mode("overwrite").parquet(f"{folder}/labels")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Model:
        return cls(spark.read.parquet(f"{folder}/tokens"), spark.read.parquet(f"{folder}/labels"))

    def summary(self) -> DataFrame:
        blocked = F.sum(F.when(F.col("label") == fixed.BLOCKED_LABEL, F.col("examples_count")))
        return self.labels.agg(
            F.coalesce(F.sum("examples_count"), F.lit(0)).alias("examples_count"),
            F.count("*").alias("labels_count"),
            F.coalesce(blocked, F.lit(0)).alias("blocked_s4_examples"),
        )

    def centroids(self) -> DataFrame:
        """(label, token, weight), one row per label and token."""
        return self.tokens.select("token", F.inline("centroids")).select("label", "token", "weight")


def train(records: DataFrame, counts: DataFrame, *, materialize: bool = False) -> Model:
    """Learn a centroid per label from records with ``record_id`` and ``expected``.

    ``counts`` are their token counts, with ``expected`` kept.  With
    ``materialize`` the token table, the label means and the model are
    written, since each is read more than once.
    """
    keep = written if materialize else lambda df: df
    labels = records.groupBy(F.col("expected").alias("label")).agg(F.count("*").alias("examples_count"))
    tokens = keep(document_frequency(counts, records.agg(F.count("*")).scalar()))

    # Mean of a label's vectors: tokens of a label are summed where they are, then
    # divided; the label lengths are one small row per label.
    sums = (
        vectors(counts, tokens)
        .groupBy(F.col("expected").alias("label"), "token")
        .agg(F.sum("weight").alias("_sum"))
    )
    means = keep(sums.join(labels, "label").select("label", "token", (F.col("_sum") / F.col("examples_count")).alias("_mean")))
    lengths = means.groupBy("label").agg(F.sqrt(F.sum(F.col("_mean") * F.col("_mean"))).alias("_length"))
    centroids = (
        means.join(lengths, "label")
        .select("label", "token", F.round(F.col("_mean") / F.col("_length"), 8).alias("weight"))
        .groupBy("token")
        .agg(F.array_sort(F.collect_list(F.struct("label", "weight"))).alias("centroids"))
    )
    nothing = F.array().cast("array<struct<label:string,weight:double>>")
    joined = tokens.join(centroids, "token", "left").select(
        "token", "df", "idf", F.coalesce("centroids", nothing).alias("centroids")
    )
    return Model(keep(joined), keep(labels))


def predict(
    records: DataFrame, counts: DataFrame, model: Model, top_k: int, *keep: str,
    guarded: Callable[[], Column] | None = None,
) -> DataFrame:
    """The ``top_k`` labels by cosine, ties by label: (record_id, kept columns, rank, label, score).

    A label that shares no token with a record scores 0.  Where ``guarded``
    holds, the only label is the blocked one.
    """
    known = vectors(counts, model.tokens)
    scores = (
        known.select(ID, "weight", F.inline("centroids").alias("label", "_centroid"))
        .groupBy(ID, "label")
        .agg(F.round(F.sum(F.col("weight") * F.col("_centroid")), 6).alias("score"))
        .groupBy(ID)
        .agg(F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("_scores"))
    )
    # Labels are the classes of the model: one short array.
    labels = model.labels.agg(F.array_sort(F.collect_list("label"))).scalar()
    everything = records.select(ID, *keep, (guarded() if guarded else F.lit(False)).alias("_guarded")).withColumn("_labels", labels)
    joined = everything.join(scores, ID, "left")
    ranked = F.slice(
        F.array_sort(
            F.transform(
                "_labels",
                lambda label: F.struct(
                    (-F.coalesce(F.element_at("_scores", label), F.lit(0.0))).alias("minus"), label.alias("label")
                ),
            )
        ),
        1, top_k,
    )
    blocked = F.array(F.struct(F.lit(-1.0).alias("minus"), F.lit(fixed.BLOCKED_LABEL).alias("label")))
    chosen = F.when(F.coalesce("_guarded", F.lit(False)), blocked).otherwise(ranked)
    return joined.select(ID, *keep, F.posexplode(chosen).alias("_at", "_p")).select(
        ID, *keep, (F.col("_at") + 1).alias("rank"), F.col("_p.label").alias("label"),
        (-F.col("_p.minus") + F.lit(0.0)).alias("score"),
    )


def is_s4() -> Column:
    return F.col("source_sensitivity") == "S4"


def evaluate(predictions: DataFrame, top_k: int) -> DataFrame:
    """Accuracy of predictions that carry their ``expected`` label, as one row."""
    hit = F.col("label") == F.col("expected")
    per_record = predictions.groupBy(ID, "expected").agg(
        F.bool_or(hit & (F.col("rank") == 1)).alias("_first"), F.bool_or(hit & (F.col("rank") <= top_k)).alias("_top")
    )
    blocked = F.col("expected") == fixed.BLOCKED_LABEL

    def share(hits: Column, total: Column) -> Column:
        return F.bround(hits / F.greatest(total, F.lit(1)), 4)

    total, blocked_total = F.count("*"), F.count_if(blocked)
    return per_record.agg(
        total.alias("examples_count"),
        share(F.count_if("_first"), total).alias("top1_accuracy"),
        share(F.count_if("_top"), total).alias("topk_accuracy"),
        share(F.count_if(blocked & F.col("_first")), blocked_total).alias("blocked_s4_recall"),
        blocked_total.alias("blocked_s4_examples"),
    )


# --- suggestions ---------------------------------------------------------------------------------
def suggest(
    columns: DataFrame, sources: DataFrame, model: Model, *, top_k: int = 3, min_score: float = fixed.STRONG_SCORE
) -> DataFrame:
    """The best fields of each column within each entity its source may hold; S4 columns are blocked."""
    context = sources.select("source_ref", F.col("inferred_entities"))
    candidates = columns.join(context, "source_ref").select(
        "source_ref", F.col("column").alias("source_column"), F.col("normalized").alias("source_column_normalized"),
        F.col("inferred_type").alias("source_type"), F.col("sensitivity").alias("source_sensitivity"),
        F.col("examples").alias("source_examples"), F.col("top_values").alias("source_top_values"),
        F.lit(None).cast("string").alias("transform"), F.explode_outer("inferred_entities").alias("entity"),
    )
    open_columns = candidates.where(F.coalesce("source_sensitivity", F.lit("")) != "S4").withColumn(
        ID, F.concat_ws("|", "source_ref", "source_column", text(F.col("entity")))
    )
    kept = ("source_ref", "source_column", "source_type", "source_sensitivity", "entity", "source_examples")
    # Every label is ranked, since the filters below come before the cut at top_k.
    all_labels = len(fixed.TARGET_FIELDS) + 1
    counts = token_counts(open_columns, column_features())
    predicted = predict(open_columns, counts, model, all_labels, *kept)
    targets = target_fields(columns.sparkSession).select(
        F.concat_ws(".", "entity", "target_field").alias("label"), F.col("entity").alias("target_entity"),
        "target_field", "target_type",
    )
    fitting = (
        predicted.where(F.col("label") != fixed.BLOCKED_LABEL)
        .join(targets, "label", "left")
        .where(
            (F.col("entity").isNull() | (F.col("target_entity") == F.col("entity")))
            & target_type_compatible(F.col("source_type"), F.col("target_type"))
            & (F.col("score") >= min_score)
        )
    )
    order = Window.partitionBy(ID).orderBy(F.desc("score"), "label")
    ranked = fitting.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    found = ranked.select(
        "source_ref", "source_column", "source_type", "source_sensitivity",
        F.col("entity").alias("candidate_entity"), "rank", F.col("label").alias("target"),
        F.col("target_entity").alias("entity"), "target_field", "target_type", "score",
        suggestion_status(F.col("score")).alias("status"), F.col("source_examples").alias("examples"),
    )
    blocked = columns.where("sensitivity = 'S4'").select(
        "source_ref", F.col("column").alias("source_column"), F.col("inferred_type").alias("source_type"),
        F.col("sensitivity").alias("source_sensitivity"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"),
        F.lit("blocked_s4").alias("status"), "examples",
    )
    return found.unionByName(blocked, allowMissingColumns=True)


def suggestion_summary(columns: DataFrame, sources: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Counts of sources, columns and suggestions by status, as one row."""
    status = F.col("status")
    return suggestions.agg(
        F.count("*").alias("suggestions_count"),
        F.count_if(status == "blocked_s4").alias("blocked_s4_columns"),
        F.count_if(status == "strong_candidate").alias("strong_candidates"),
        F.count_if(status == "review_candidate").alias("review_candidates"),
        F.count_if(status == "low_confidence").alias("low_confidence"),
    ).select(
        sources.agg(F.count("*")).scalar().alias("files_count"),
        columns.agg(F.count("*")).scalar().alias("columns_count"), "*",
    )
