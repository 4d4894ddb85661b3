"""The registry: column decisions remembered from one set of exports to the next."""

from __future__ import annotations

import uuid
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.functions.keys import stable_id
from harmonia.functions.text import normalize, text
from harmonia.operators.review import Decisions
from harmonia.plans.mapping_document import Mapping, column_review_id

SNAPSHOT = "snapshot-"
ATTEMPTS = 100

SCHEMA = (
    "id string, source_system string, schema_version string, source_column string, source_column_normalized string, "
    "source_type string, source_sensitivity string, entity string, target_field string, target_sensitivity string, "
    "transform string, status string, decision_count bigint, first_learned_at timestamp, last_learned_at timestamp, "
    "last_reviewer string, last_reason string"
)


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def _path(spark: SparkSession, place: str):
    return spark._jvm.org.apache.hadoop.fs.Path(place)


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the stored snapshots, oldest first."""
    path = _path(spark, folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [status.getPath().getName() for status in store.listStatus(path)]
    return sorted(int(n.removeprefix(SNAPSHOT)) for n in names if n.startswith(SNAPSHOT))


def load_registry(spark: SparkSession, folder: str | None, number: int | None = None) -> DataFrame:
    """A stored snapshot, the latest one by default; empty where there is none."""
    held = snapshots(spark, folder) if folder else []
    if not held and number is None:
        return empty_registry(spark)
    return spark.read.schema(SCHEMA).parquet(_snapshot(folder, held[-1] if number is None else number))


def _snapshot(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/{SNAPSHOT}{number:08d}"


def publish(registry: DataFrame, folder: str, number: int) -> bool:
    """Stores ``registry`` as the snapshot of this number; False where another one has it already.

    The snapshot is written aside and takes its name in one rename that never
    replaces, so readers see all of it or nothing and a number is given once.
    The folder needs a store whose renames are atomic.
    """
    spark = registry.sparkSession
    aside = f"{folder.rstrip('/')}/.{uuid.uuid4().hex}"
    registry.write.parquet(aside)
    jvm = spark._jvm
    source, target = _path(spark, aside), _path(spark, _snapshot(folder, number))
    configuration = spark._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.getFileSystem(configuration).getUri(), configuration)
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(source, target, plain)
    except Py4JJavaError as error:
        files.delete(source, True)
        if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
            return False
        raise
    return True


def learn(learned: DataFrame, folder: str, attempts: int = ATTEMPTS) -> int:
    """Merges ``learned`` into the latest snapshot and stores the result as the next one; returns its number.

    If another learner has stored that number meanwhile, its snapshot is the new
    base and the merge is made again, so the decisions of both are kept.
    """
    spark = learned.sparkSession
    for _ in range(attempts):
        number = next(reversed(snapshots(spark, folder)), 0)
        known = load_registry(spark, folder, number) if number else empty_registry(spark)
        if publish(merge_entries(known, learned), folder, number + 1):
            return number + 1
    raise RuntimeError(f"{folder}: {attempts} other learners were faster each time")


def prune(spark: SparkSession, folder: str, keep: int) -> None:
    """Removes all but the latest ``keep`` snapshots."""
    for number in snapshots(spark, folder)[:-max(keep, 1)]:
        path = _path(spark, _snapshot(folder, number))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def entry_id(source_system, column, entity, target_field, transform):
    return stable_id(source_system, normalize(column), entity, target_field, text(transform))


def learned_entries(mapping: Mapping, decisions: Decisions, now: datetime) -> DataFrame:
    """Registry entries of the approved columns; equal columns of several sources count together."""
    approved = mapping.review_queue.withColumn("_review", column_review_id()).join(
        decisions.approved_columns().select(F.col("id").alias("_review"), "reviewer", "reason"), "_review"
    )
    system = F.lit(mapping.source_system)
    entries = approved.withColumn(
        "id", entry_id(system, F.col("source_column"), F.col("entity"), F.col("target_field"), F.col("transform"))
    )
    order = F.struct("source_ref", "source_column")
    payload = F.struct("source_column", "source_type", "source_sensitivity", "entity", "target_field", "target_sensitivity", "transform")
    grouped = entries.groupBy("id").agg(
        F.min_by(payload, order).alias("_p"),
        F.max_by(F.struct("reviewer", "reason"), order).alias("_last"),
        F.count("*").alias("decision_count"),
    )
    stamp = F.lit(now).cast("timestamp")
    return grouped.select(
        "id", system.alias("source_system"), F.lit(mapping.schema_version).alias("schema_version"),
        "_p.source_column", normalize(F.col("_p.source_column")).alias("source_column_normalized"),
        "_p.source_type", "_p.source_sensitivity", "_p.entity", "_p.target_field", "_p.target_sensitivity", "_p.transform",
        F.lit(fixed.BY_HUMAN).alias("status"), "decision_count",
        stamp.alias("first_learned_at"), stamp.alias("last_learned_at"),
        text(F.col("_last.reviewer")).alias("last_reviewer"), text(F.col("_last.reason")).alias("last_reason"),
    )


def merge_entries(registry: DataFrame, learned: DataFrame) -> DataFrame:
    """Known entries count one more decision and keep their origin; new ones are added."""
    old, new = registry.alias("old"), learned.alias("new")
    joined = old.join(new, F.col("old.id") == F.col("new.id"), "full_outer")
    updated = {"last_learned_at", "last_reviewer", "last_reason"}

    def merged(name: str):
        first, second = ("new", "old") if name in updated else ("old", "new")
        return F.coalesce(F.col(f"{first}.{name}"), F.col(f"{second}.{name}")).alias(name)

    total = F.coalesce("old.decision_count", F.lit(0)) + F.coalesce("new.decision_count", F.lit(0))
    return joined.select(*[total.alias(c) if c == "decision_count" else merged(c) for c in registry.columns])


def apply_registry(proposals: DataFrame, registry: DataFrame, source_system: str) -> DataFrame:
    """Proposals known from earlier reviews of the same system become certain."""
    known = registry.where(F.col("source_system") == source_system).select(
        normalize(F.col("source_column")).alias("_name"), F.col("entity").alias("_entity"),
        F.col("target_field").alias("_field"), text(F.col("transform")).alias("_transform"), F.col("id").alias("_id"),
    )
    joined = proposals.join(
        known,
        (normalize(F.col("source_column")) == F.col("_name")) & (F.col("entity") == F.col("_entity"))
        & (F.col("target_field") == F.col("_field")) & (text(F.col("transform")) == F.col("_transform")),
        "left",
    )
    hit = F.col("_id").isNotNull()
    changed = {
        "status": F.when(hit, fixed.BY_REGISTRY).otherwise(F.col("status")),
        "confidence_score": F.when(hit, F.greatest("confidence_score", F.lit(fixed.REGISTRY_CONFIDENCE))).otherwise(F.col("confidence_score")),
        "justification": F.when(hit, F.concat("justification", F.lit("; registry="), "_id")).otherwise(F.col("justification")),
    }
    return joined.select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in proposals.columns], F.col("_id").alias("registry_entry_id")
    )
