"""The three runs of the engine: propose a mapping, apply reviews, build the tables.

Stages hand written tables to each other, so a lost executor costs at most the
running stage, and no stage plans the lineage of the ones before it again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from harmonia.fixed_values import STRONG_SCORE
from harmonia.operators import matching, profiling, quality, registry, review, source_graph, text_model
from harmonia.operators.key_resolution import JoinContext
from harmonia.operators.standard_tables import Settings
from harmonia.operators.table_run import run_tables
from harmonia.plans.mapping_document import Mapping, ReviewQueue, assemble, review_queue
from harmonia.sources.artifacts import path_exists, write_artifacts
from harmonia.sources.exports import Bronze


@dataclass(frozen=True)
class Proposed:
    bronze: Bronze
    profiles: profiling.Profiles
    proposals: DataFrame
    mapping: Mapping
    queue: ReviewQueue
    suggestions: DataFrame | None = None


def read_profiles(spark: SparkSession, workdir: str) -> profiling.Profiles:
    return profiling.Profiles(
        spark.read.parquet(f"{workdir}/profile_columns"), spark.read.parquet(f"{workdir}/profile_sources")
    )


def read_counts(spark: SparkSession, workdir: str) -> profiling.ValueCounts:
    """Written value counts; the texts of long values are those of the landed sources."""
    sources = Bronze(spark, f"{workdir}/bronze").sources()
    return profiling.value_counts(sources.values()).stored(spark.read.parquet(f"{workdir}/value_counts"))


def propose(
    spark: SparkSession, exports_dir: str, workdir: str, *, source_system: str, schema_version: str,
    registry_dir: str | None = None, exact_overlap: bool = True, model: text_model.Model | None = None,
    top_k: int = 3, min_score: float = STRONG_SCORE,
) -> Proposed:
    """Land and profile the exports, find joins, match columns, and write the draft.

    ``exact_overlap`` compares all distinct values of two columns; otherwise the
    twenty smallest of each, as the profiles keep them.  A trained ``model`` adds
    its suggestions for every column.
    """
    bronze = Bronze.land(spark, exports_dir, f"{workdir}/bronze")
    sources = bronze.sources()
    # The one data-sized shuffle of this run, written once and read by everything below.
    counts = None
    if any(table.columns for table in sources.values()):
        write_artifacts({"value_counts": profiling.value_counts(sources.values()).rows}, workdir)
        counts = read_counts(spark, workdir)
    made = profiling.profile(spark, sources.values(), counts)
    write_artifacts({"profile_columns": made.columns, "profile_sources": made.sources}, workdir)
    profiles = read_profiles(spark, workdir)

    candidates = source_graph.join_candidates(
        profiles.columns, profiles.sources, counts if exact_overlap else None
    )
    write_artifacts({"join_candidates": candidates}, workdir)
    candidates = spark.read.parquet(f"{workdir}/join_candidates")

    proposals = matching.propose_mappings(profiles.columns, profiles.sources, counts=counts)
    known = registry.load_registry(spark, registry_dir)
    write_artifacts({"proposals": registry.apply_registry(proposals, known, source_system)}, workdir)
    proposals = spark.read.parquet(f"{workdir}/proposals")

    mapping = assemble(
        profiles, proposals, matching.blocked_columns(profiles.columns), candidates,
        source_graph.join_rules(candidates), source_system=source_system, schema_version=schema_version, counts=counts,
    ).written(f"{workdir}/mapping_draft")
    queue = review_queue(mapping)
    write_queue(queue, workdir)
    suggestions = None
    if model is not None:
        found = text_model.suggest(profiles.columns, profiles.sources, model, top_k=top_k, min_score=min_score)
        write_artifacts({"suggestions": found}, workdir)
        suggestions = spark.read.parquet(f"{workdir}/suggestions")
    return Proposed(bronze, profiles, proposals, mapping, queue, suggestions)


def write_queue(queue: ReviewQueue, workdir: str) -> None:
    write_artifacts(
        {"queue_columns": queue.columns, "queue_values": queue.values, "queue_rules": queue.rules}, workdir
    )


def read_queue(spark: SparkSession, workdir: str) -> ReviewQueue:
    return ReviewQueue(*[spark.read.parquet(f"{workdir}/queue_{part}") for part in ("columns", "values", "rules")])


def review_base(spark: SparkSession, workdir: str) -> Mapping:
    """The reviewed mapping where the written queue is still its own, else the draft."""
    reviewed = f"{workdir}/mapping_reviewed"
    if Mapping.exists(spark, reviewed) and path_exists(spark, f"{workdir}/queue_columns"):
        mapping = Mapping.load(spark, reviewed)
        if read_queue(spark, workdir).same_pending(review_queue(mapping)):
            return mapping
    return Mapping.load(spark, f"{workdir}/mapping_draft")


def apply_review(
    spark: SparkSession, workdir: str, decisions: review.Decisions, *, registry_dir: str | None = None,
    now: datetime | None = None, drop_rejected: bool = False,
) -> review.Reviewed:
    """Apply decisions to the current mapping, learn from them, and rewrite mapping and queue."""
    base = review_base(spark, workdir)
    profiles = read_profiles(spark, workdir)
    reviewed = review.apply_decisions(
        base, decisions, profiles.columns, drop_rejected=drop_rejected,
        counts=read_counts(spark, workdir) if path_exists(spark, f"{workdir}/value_counts") else None, sources=profiles.sources,
    )
    if registry_dir:
        learned = registry.learned_entries(base, decisions, now or datetime.now(timezone.utc))
        if not learned.isEmpty():
            registry.learn(learned, registry_dir)
    # Written aside first: the base may itself be read from mapping_reviewed.
    staged = reviewed.mapping.written(f"{workdir}/mapping_staged")
    mapping = staged.written(f"{workdir}/mapping_reviewed")
    write_queue(review_queue(mapping), workdir)
    return replace(reviewed, mapping=mapping)


@dataclass(frozen=True)
class Transformed:
    tables: dict[str, DataFrame]
    quality: DataFrame
    usage: DataFrame
    losses: DataFrame

    @property
    def row_counts(self) -> DataFrame:
        return self.losses.select("table", "row_count")


def transform(spark: SparkSession, mapping: Mapping, bronze: Bronze, output: str, settings: Settings) -> Transformed:
    """Build and write the standard tables, then check them."""
    sources = bronze.sources()
    context = JoinContext.build(sources, mapping.join_rules)
    run = run_tables(spark, mapping.entity_maps(), context, settings, output)
    write_artifacts({"_usage": run.usage, "_losses": run.losses}, output)
    rules = quality.quality_rules(mapping, sources, run.tables, run.usage, context.index_diagnostics())
    write_artifacts({"_quality": rules}, output)
    return Transformed(run.tables, spark.read.parquet(f"{output}/_quality"), run.usage, run.losses)
