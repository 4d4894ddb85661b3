"""Cohort evaluation: static criteria, event sequences, attrition and diagnostics.

Every criterion becomes a flag of a worker.  The flags of all criteria, the
event counts and the pair counts meet in one aggregate keyed by worker
(`worker_flags`); the whole attrition ladder is then one more aggregate over
that table, not one job per step.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harmonia import fixed_values as fixed
from harmonia.functions.text import normalize, normalize_upper, text
from harmonia.functions.values import age_at, parse_date, plain_boolean_text, plain_scalar
from harmonia.operators.sequences import sequence_pairs
from harmonia.plans.cohort_definition import CONCLUSION, VISIT, WORKER, CohortDefinition, EventDefinition
from harmonia.session import cut_lineage
from harmonia.sources.artifacts import write_artifacts

Tables = Mapping[str, DataFrame]


# --- predicates --------------------------------------------------------------------------
@dataclass(frozen=True)
class Reader:
    """Reads columns of the standard tables; an absent column reads as the empty text.

    ``normalized`` names the ``table.column`` pairs that already hold upper-case
    normalised text.  Equality on those, and on boolean columns, is a plain
    comparison that reaches the Parquet scan.
    """

    tables: Tables
    normalized: Collection[str] = ()
    _types: dict[str, dict[str, T.DataType]] = field(default_factory=dict)

    def types(self, table: str) -> dict[str, T.DataType]:
        """Column types of a table, asked from Spark once."""
        if table not in self._types:
            self._types[table] = {f.name: f.dataType for f in self.tables[table].schema.fields}
        return self._types[table]

    def _is_boolean(self, table: str, column: str) -> bool:
        return isinstance(self.types(table).get(column), T.BooleanType)

    def raw(self, table: str, column: str) -> Column:
        return F.col(f"`{column}`") if column in self.types(table) else F.lit(None).cast("string")

    def string(self, table: str, column: str) -> Column:
        return text(self.raw(table, column).cast("string"))

    def date(self, table: str, column: str) -> Column:
        if column not in self.types(table):
            return F.lit(None).cast("date")
        if isinstance(self.types(table)[column], (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.col(column).cast("date")
        return parse_date(F.col(column).cast("string"))

    def _plain(self, table: str, column: str) -> bool:
        return f"{table}.{column}" in self.normalized

    def upper_in(self, table: str, column: str, expected: Collection[str]) -> Column:
        """Normalised upper-case value among ``expected``."""
        if self._plain(table, column):
            return self.raw(table, column).isin(*expected)
        return text(normalize_upper(self.string(table, column))).isin(*expected)

    def boolean_is(self, table: str, column: str, expected: str) -> Column:
        if self._is_boolean(table, column):
            return F.col(column) == F.lit(expected == "true") if expected in ("true", "false") else F.lit(False)
        return _among_scalars(normalize(self.string(table, column)), None, [expected])

    def scalar_in(self, table: str, column: str, expected: Collection[str]) -> Column:
        """Comparison form used by event filters, among ``expected`` plain scalars."""
        if self._is_boolean(table, column):
            hits = [F.col(column) == F.lit(v == "true") for v in expected if v in ("true", "false")]
            hits += [F.col(column).isNull() for v in expected if v == ""]
            return reduce(Column.__or__, hits, F.lit(False))
        if self._plain(table, column) and "" not in expected:
            words = {"true": fixed.TRUE_WORDS, "false": fixed.FALSE_WORDS}
            spelled = [w for v in expected for w in ([x.upper() for x in words[v]] if v in words else [v])]
            return self.raw(table, column).isin(*spelled)
        value = self.string(table, column)
        return _among_scalars(normalize(value), normalize_upper(value), expected)


def _among_scalars(plain: Column, upper: Column | None, expected: Collection[str]) -> Column:
    """Membership by comparison form: the yes and no words, else the upper form (or the plain one).

    An expected value that is neither yes nor no can only equal texts that are
    neither as well, so each form is computed at most once per row.
    """
    words = {"true": fixed.TRUE_WORDS, "false": fixed.FALSE_WORDS}
    spelled = [w for v in expected for w in words.get(v, [])]
    others = [v for v in expected if v not in words]
    tests = [plain.isin(*spelled)] if spelled else []
    if others:
        tests.append((plain if upper is None else upper).isin(*others))
    return F.coalesce(reduce(Column.__or__, tests, F.lit(False)), F.lit(False))


def event_predicate(reader: Reader, table: str, filters: Mapping[str, Any]) -> Column:
    """Conjunction over the fields of an event filter."""

    def matches(column: str, expected: Any) -> Column:
        if isinstance(expected, Mapping):
            if "any" in expected:
                return matches(column, _items(expected["any"]))
            if "equals" in expected:
                return matches(column, expected["equals"])
            if "not_any" in expected:
                return ~F.coalesce(matches(column, _items(expected["not_any"])), F.lit(False))
            return F.lit(False)
        if isinstance(expected, (list, tuple)):
            simple = [plain_scalar(v) for v in expected if not isinstance(v, (Mapping, list, tuple))]
            nested = [matches(column, v) for v in expected if isinstance(v, (Mapping, list, tuple))]
            parts = ([reader.scalar_in(table, column, simple)] if simple else []) + nested
            return reduce(Column.__or__, parts, F.lit(False))
        return reader.scalar_in(table, column, [plain_scalar(expected)])

    conditions = [F.coalesce(matches(name, expected), F.lit(False)) for name, expected in filters.items()]
    return reduce(Column.__and__, conditions, F.lit(True))


def _items(value: Any) -> list[Any]:
    if value is None or value == "":
        return []
    return list(value) if isinstance(value, (list, tuple)) else [value]


# --- signals: one row per worker with the criteria it meets -----------------------------------
def visits_by_id(reader: Reader, *columns: Column, both_ids: bool = False) -> DataFrame:
    """One row per visit id: its last row (by ``row_ordinal`` where the table has one)."""
    visits = reader.tables[VISIT]
    names = reader.types(VISIT)
    order = ["row_ordinal"] if "row_ordinal" in names else sorted(names)
    picked = visits.select(
        reader.string(VISIT, "visite_id").alias("visite_id"),
        reader.string(VISIT, "travailleur_id").alias("travailleur_id"),
        *columns,
        F.struct(*[F.col(f"`{name}`") for name in order]).alias("_order"),
    ).where(F.col("visite_id") != "")
    if both_ids:
        picked = picked.where(F.col("travailleur_id") != "")
    kept = [name for name in picked.columns if name not in ("visite_id", "_order")]
    return (
        picked.groupBy("visite_id")
        .agg(F.max_by(F.struct(*kept), "_order").alias("_visit"))
        .select("visite_id", "_visit.*")
    )


def _signal(df: DataFrame, worker: Column, flags: Mapping[str, Column]) -> DataFrame:
    anything = reduce(Column.__or__, (F.coalesce(c, F.lit(False)) for c in flags.values()))
    return (
        df.select(worker.alias("travailleur_id"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])
        if "_source" in flags
        else df.where(anything).select(
            worker.alias("travailleur_id"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()]
        )
    )


def criteria_steps(definition: CohortDefinition) -> list[tuple[str, str]]:
    """Static steps in evaluation order: (step id, label)."""
    d = definition
    steps = []
    if d.min_age is not None:
        steps.append(("population:min_age", f"Age >= {d.min_age}"))
    if d.max_age is not None:
        steps.append(("population:max_age", f"Age <= {d.max_age}"))
    if d.regions:
        steps.append(("population:region", f"Region in {', '.join(d.regions)}"))
    if d.sexes:
        steps.append(("population:sex", f"Sexe in {', '.join(d.sexes)}"))
    if d.follow_ups:
        steps.append(("population:suivi_type", "Type de suivi"))
    if d.exposures:
        steps.append(("criteria:exposure", "Exposition professionnelle"))
    if d.visit_types:
        steps.append(("criteria:visit_type", "Type de visite"))
    if d.conclusions:
        steps.append(("criteria:conclusion", "Conclusion médicale"))
    steps += [(f"criteria:{name}", str(name)) for name in d.flags]
    return steps


def criteria_signals(definition: CohortDefinition, reader: Reader) -> list[DataFrame]:
    """A DataFrame of (worker, flags) per scanned table; flags are named by step id."""
    d = definition
    signals = []

    def worker(table: str) -> Column:
        return reader.string(table, "travailleur_id")

    own: dict[str, Column] = {"_source": F.lit(True)}
    age = age_at(reader.string(WORKER, "annee_naissance"), d.reference_year or 0)
    if d.min_age is not None:
        own["population:min_age"] = age >= d.min_age
    if d.max_age is not None:
        own["population:max_age"] = age <= d.max_age
    if d.sexes:
        own["population:sex"] = reader.upper_in(WORKER, "sexe", d.sexes)
    if d.follow_ups:
        own["population:suivi_type"] = reader.upper_in(WORKER, "suivi_type_concept_id", d.follow_ups)
    signals.append(_signal(reader.tables[WORKER].where(worker(WORKER) != ""), worker(WORKER), own))

    if d.regions:
        sites = (
            reader.tables["etablissement"]
            .where(text(normalize(reader.string("etablissement", "region"))).isin(*d.regions))
            .select(reader.string("etablissement", "etablissement_id").alias("etablissement_id"))
            .distinct()
        )
        jobs = reader.tables["episode_poste"].select(
            reader.string("episode_poste", "etablissement_id").alias("etablissement_id"),
            worker("episode_poste").alias("travailleur_id"),
        )
        # The sites of a region are few; AQE measures them and splits what is skewed.
        inside = jobs.join(sites, "etablissement_id", "left_semi")
        signals.append(_signal(inside, F.col("travailleur_id"), {"population:region": F.lit(True)}))
    if d.exposures:
        table = "exposition_professionnelle"
        hit = reader.upper_in(table, "exposition_concept_id", d.exposures)
        signals.append(_signal(reader.tables[table], worker(table), {"criteria:exposure": hit}))
    if d.visit_types:
        hit = reader.upper_in(VISIT, "type_visite_concept_id", d.visit_types)
        signals.append(_signal(reader.tables[VISIT], worker(VISIT), {"criteria:visit_type": hit}))
    if d.conclusions or d.flags:
        flags = {}
        if d.conclusions:
            flags["criteria:conclusion"] = reader.upper_in(CONCLUSION, "conclusion_concept_id", d.conclusions)
        for name, expected in d.flags.items():
            flags[f"criteria:{name}"] = reader.boolean_is(CONCLUSION, str(name), plain_boolean_text(expected))
        # All flags in one pass, reduced to one row per visit before the join.
        per_visit = (
            _signal(reader.tables[CONCLUSION], reader.string(CONCLUSION, "visite_id"), flags)
            .groupBy(F.col("travailleur_id").alias("visite_id"))
            .agg(*[F.max(F.col(f"`{n}`")).alias(n) for n in flags])
        )
        signals.append(per_visit.join(visits_by_id(reader, both_ids=True), "visite_id").drop("visite_id"))
    return signals


# --- events ------------------------------------------------------------------------------------
def event_days(
    definition: CohortDefinition, reader: Reader, event_columns: Mapping[str, str]
) -> DataFrame | None:
    """Records per worker and day, one count column per event.

    Events that read the same table, worker and date share one scan, and every
    scan is aggregated before it is joined or merged with another.
    """
    groups: dict[tuple[str, bool, str, str], list[EventDefinition]] = {}
    for event in definition.events:
        if event.table in reader.tables:
            worker = "" if event.linked else event.worker_field
            groups.setdefault((event.table, event.linked, worker, event.date_column), []).append(event)

    parts = []
    for (table, linked, worker_field, date_column), events in groups.items():
        hits = {event_columns[e.name]: event_predicate(reader, table, e.filters) for e in events}
        rows = reader.tables[table].where(reduce(Column.__or__, hits.values()))
        counts = [F.col(name).cast("bigint").alias(name) for name in hits]
        flags = [hit.alias(name) for name, hit in hits.items()]
        if linked:
            per_visit = (
                rows.select(reader.string(table, "visite_id").alias("visite_id"), *flags)
                .select("visite_id", *counts)
                .groupBy("visite_id")
                .agg(*[F.sum(name).alias(name) for name in hits])
            )
            dated = per_visit.join(
                visits_by_id(reader, reader.date(VISIT, date_column).alias("event_date")), "visite_id"
            )
        else:
            dated = rows.select(
                reader.string(table, worker_field).alias("travailleur_id"),
                reader.date(table, date_column).alias("event_date"), *flags,
            ).select("travailleur_id", "event_date", *counts)
        parts.append(
            dated.where((F.col("travailleur_id") != "") & F.col("event_date").isNotNull())
            .groupBy("travailleur_id", "event_date")
            .agg(*[F.sum(name).alias(name) for name in hits])
        )
    if not parts:
        return None
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if len(parts) > 1:
        merged = merged.groupBy("travailleur_id", "event_date").agg(
            *[F.sum(name).alias(name) for name in merged.columns if name not in ("travailleur_id", "event_date")]
        )
    zero = F.lit(0).cast("bigint")
    return merged.select(
        "travailleur_id", "event_date",
        *[
            (F.coalesce(F.col(name), zero) if name in merged.columns else zero).alias(name)
            for name in event_columns.values()
        ],
    )


# --- evaluation -----------------------------------------------------------------------------------
@dataclass(frozen=True)
class CohortResult:
    """Parts of a result, each a DataFrame.

    ``workers`` has a row per worker with its flags; ``counts`` is one row with
    every number of the ladder; the others are views of these two.
    """

    definition: CohortDefinition
    required_tables: list[str]
    missing_tables: list[str]
    workers: DataFrame
    counts: DataFrame
    steps: DataFrame
    events: DataFrame
    sequences: DataFrame
    availability: DataFrame
    diagnostics: DataFrame
    summary: DataFrame
    included: DataFrame
    recount: Callable[[DataFrame], DataFrame]
    assemble: Callable[[DataFrame, DataFrame], CohortResult]

    def save(self, folder: str) -> None:
        """Write the parts of the result as tables of a folder.

        Workers and the row of counts are written first, each in one pass, and
        the others are made of what was written.
        """
        spark = self.workers.sparkSession
        write_artifacts({"workers": self.workers}, folder)
        workers = spark.read.schema(self.workers.schema).parquet(f"{folder}/workers")
        write_artifacts({"counts": self.recount(workers)}, folder)
        whole = self.assemble(workers, spark.read.schema(self.counts.schema).parquet(f"{folder}/counts"))
        parts = ("steps", "events", "sequences", "availability", "diagnostics", "summary", "included")
        write_artifacts({name: getattr(whole, name) for name in parts}, folder)


def worker_flags(
    definition: CohortDefinition, reader: Reader, event_columns: Mapping[str, str], compat: bool = False
) -> DataFrame:
    """One row per worker: source and criteria flags, event records, sequence pairs."""
    signals = criteria_signals(definition, reader)
    numbers: list[str] = []
    if definition.longitudinal:
        days = event_days(definition, reader, event_columns)
        numbers = [*event_columns.values(), *[f"pairs_{i}" for i in range(len(definition.sequences))]]
        if days is not None:
            signals.append(sequence_pairs(days, definition.sequences, dict(event_columns), compat))
    flags = ["_source", *[step for step, _ in criteria_steps(definition)]]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), signals)
    present = set(merged.columns)

    def total(name: str) -> Column:
        column = F.sum(F.col(name)) if name in present else F.lit(None)
        return F.coalesce(column.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(name)

    return merged.groupBy("travailleur_id").agg(
        *[F.coalesce(F.max(F.col(f"`{n}`")), F.lit(False)).alias(n) for n in flags],
        *[total(name) for name in numbers],
    )


def evaluate_cohort(
    spark: SparkSession,
    tables: Tables,
    definition: CohortDefinition | Mapping[str, Any],
    *,
    normalized_columns: Collection[str] = (),
    compat: bool = False,
    materialize: bool = False,
) -> CohortResult:
    """Evaluate a definition over the standard tables.

    ``tables`` holds the tables that exist; a needed table that is not in it is
    reported and ends the evaluation with an empty inclusion.  With
    ``materialize`` the worker table and the row of counts are written, so that
    reading several parts of the result computes them once.
    """
    if not isinstance(definition, CohortDefinition):
        definition = CohortDefinition.from_dict(definition)
    if definition.reference_year is None and (definition.min_age is not None or definition.max_age is not None):
        raise ValueError("an age criterion needs an explicit reference_year")
    fields = definition.required_fields()
    required = list(fields)
    missing = [table for table in required if table not in tables]
    reader = Reader(tables, normalized_columns)
    event_columns = {e.name: f"records_{i}" for i, e in enumerate(definition.events)} if definition.longitudinal else {}

    if missing:
        population = CohortDefinition(name=definition.name)
        active = definition.__class__(name=definition.name)
        event_columns = {}
        workers = (
            worker_flags(population, reader, {})
            if WORKER in tables
            else spark.createDataFrame([], "travailleur_id string, _source boolean")
        )
    else:
        active = definition
        workers = worker_flags(definition, reader, event_columns, compat)
    if materialize:
        workers = cut_lineage(workers)

    static = criteria_steps(active)
    sequences = active.sequences if active.longitudinal else ()
    passes: list[Column] = [F.col("_source")]
    for step, _ in static:
        passes.append(passes[-1] & F.col(f"`{step}`"))
    aggregates = [F.count_if(p).alias(f"step_{i}") for i, p in enumerate(passes)]
    for i, _ in enumerate(sequences):
        pairs = F.col(f"pairs_{i}")
        aggregates.append(
            F.coalesce(F.sum(F.when(passes[-1], pairs)), F.lit(0)).cast("bigint").alias(f"pairs_{i}")
        )
        passes.append(passes[-1] & (pairs > 0))
        aggregates.append(F.count_if(passes[-1]).alias(f"step_{len(passes) - 1}"))
    for name in event_columns.values():
        aggregates.append(F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name))
        aggregates.append(F.count_if(F.col(name) > 0).alias(f"workers_{name}"))
    def recount(workers: DataFrame) -> DataFrame:
        # Row counts of the needed tables ride along as scalar sub-queries; Parquet
        # answers them from its footers.
        return workers.agg(*aggregates).select(
            "*", *[tables[t].agg(F.count("*")).scalar().alias(f"rows_{t}") for t in required if t in tables]
        )

    def assemble(workers: DataFrame, counts: DataFrame) -> CohortResult:
        last = len(passes) - 1
        no_int, no_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
        step_rows = [
            _row(
                ord=F.lit(0), id=F.lit("source_population"), label=F.lit("Travailleurs source"),
                input_count=no_int, output_count=F.col("step_0"), excluded_count=F.lit(0).cast("bigint"),
                matched_pairs_count=no_int,
            )
        ]
        named = [*static, *[(f"longitudinal:{s.id}", s.label) for s in sequences]]
        for i, (step, label) in enumerate(named, start=1):
            before, after = F.col(f"step_{i - 1}"), F.col(f"step_{i}")
            pairs = F.col(f"pairs_{i - 1 - len(static)}") if i > len(static) else no_int
            step_rows.append(
                _row(ord=F.lit(i), id=F.lit(step), label=F.lit(label), input_count=before, output_count=after,
                     excluded_count=before - after, matched_pairs_count=pairs)
            )
        steps = counts.select(F.inline(F.array(*step_rows)))

        event_rows = [
            _row(id=F.lit(e.name), table=F.lit(e.table), date_field=F.lit(e.date_field),
                 records_count=F.col(event_columns[e.name]), workers_count=F.col(f"workers_{event_columns[e.name]}"))
            for e in active.events
            if event_columns
        ]
        events = _rows(counts, event_rows, "id string, table string, date_field string, records_count bigint, workers_count bigint")
        sequence_rows = [
            _row(ord=F.lit(i), id=F.lit(s.id), label=F.lit(s.label), first_event=F.lit(s.first), then_event=F.lit(s.then),
                 relation=F.lit(s.relation), min_days=F.lit(s.min_days).cast("int"), max_days=F.lit(s.max_days).cast("int"),
                 matched_pairs_count=F.col(f"pairs_{i}"), matched_workers_count=F.col(f"step_{1 + len(static) + i}"))
            for i, s in enumerate(sequences)
        ]
        sequence_df = _rows(
            counts, sequence_rows,
            "ord int, id string, label string, first_event string, then_event string, relation string, "
            "min_days int, max_days int, matched_pairs_count bigint, matched_workers_count bigint",
        )
        availability = counts.select(
            F.inline(F.array(*[
                _row(table=F.lit(t), status=F.lit("available" if t in tables else "missing"),
                     row_count=F.col(f"rows_{t}") if t in tables else F.lit(0).cast("bigint"))
                for t in required
            ]))
        )

        def issue(severity: str, code: str, present: Column, *, table: Any = None, field: Any = None,
                  subject: Any = None, message: str = "") -> Column:
            return F.when(
                present,
                _row(severity=F.lit(severity), code=F.lit(code), table=F.lit(table).cast("string"),
                     field=F.lit(field).cast("string"), subject=F.lit(subject).cast("string"), message=F.lit(message)),
            )

        issues = [
            issue("blocking", "missing_table", F.lit(True), table=t, message=f"Required table is missing: {t}")
            for t in missing
        ]
        if not missing:
            for table, names in fields.items():
                rows = F.col(f"rows_{table}")
                issues.append(issue("warning", "empty_table", rows == 0, table=table, message=f"Table is empty: {table}"))
                issues += [
                    issue("blocking", "missing_field", rows > 0, table=table, field=name,
                          message=f"Required field is missing: {table}.{name}")
                    for name in names
                    if name not in reader.types(table)
                ]
        issues += [
            issue("warning", "empty_event", F.col(event_columns[e.name]) == 0, table=e.table, subject=e.name,
                  message=f"No record for event {e.name}")
            for e in active.events
            if event_columns
        ]
        issues += [
            issue("warning", "temporal_no_match", F.col(f"pairs_{i}") == 0, subject=s.id,
                  message=f"No pair of records satisfies sequence {s.id}")
            for i, s in enumerate(sequences)
        ]
        issues += [
            issue("info", "unlinked_date_field", F.lit(True), subject=name,
                  message=f"Date field of event {name} is read from the event's own row")
            for name in active.unknown_link_prefixes()
        ]
        found = F.filter(F.array(*issues), lambda d: d.isNotNull()) if issues else None
        diagnostics = _rows(
            counts, found if found is not None else [],
            "severity string, code string, table string, field string, subject string, message string",
        )

        def severity_count(severity: str) -> Column:
            if found is None:
                return F.lit(0).cast("bigint")
            return F.size(F.filter(found, lambda d: d["severity"] == severity)).cast("bigint")

        included_count = F.lit(0).cast("bigint") if missing else F.col(f"step_{last}")
        summary = counts.select(
            F.lit(definition.name).alias("cohort_name"),
            F.lit(definition.schema_version).alias("schema_version"),
            F.when(severity_count("blocking") > 0, "not_feasible")
            .when((F.col("step_0") > 0) & (included_count == 0), "feasible_empty")
            .otherwise("feasible")
            .alias("feasibility_status"),
            F.col("step_0").alias("source_population_count"),
            included_count.alias("included_count"),
            (F.col("step_0") - included_count).alias("excluded_count"),
            F.lit(",".join(required)).alias("required_tables"),
            F.lit(",".join(missing)).alias("missing_tables"),
            F.lit(len(definition.sequences)).cast("bigint").alias("longitudinal_sequences_count"),
            severity_count("blocking").alias("blocking_diagnostics_count"),
            severity_count("warning").alias("warning_diagnostics_count"),
            (severity_count("blocking") + severity_count("warning")).alias("diagnostics_count"),
        )
        included = workers.where(F.lit(False) if missing else passes[-1]).select("travailleur_id").orderBy("travailleur_id")
        return CohortResult(
            definition, required, missing, workers, counts, steps, events, sequence_df, availability,
            diagnostics, summary, included, recount, assemble,
        )

    counts = recount(workers)
    return assemble(workers, cut_lineage(counts) if materialize else counts)


def _row(**columns: Column) -> Column:
    return F.struct(*[column.alias(name) for name, column in columns.items()])


def _rows(counts: DataFrame, rows: list[Column] | Column, schema: str) -> DataFrame:
    if isinstance(rows, list):
        if not rows:
            return counts.sparkSession.createDataFrame([], schema)
        rows = F.array(*rows)
    return counts.select(F.inline(rows))
