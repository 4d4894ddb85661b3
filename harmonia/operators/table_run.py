"""All standard tables in one run: every source is read and its keys resolved once.

The rows of a source that feeds several tables are written with their resolved
keys, and its tables are built from these.  What the run has to report (rows
read, kept and lost, keys found and missed) is observed in the writes
themselves, so nothing is counted again.
"""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from harmonia.operators.key_resolution import JoinContext
from harmonia.operators.standard_tables import (
    SITE_ROLE, SPECS, WORKER_ROLE, EntityMap, RowReader, Settings, TableSpec, build_table, finish_table, not_empty, row_reader,
)
from harmonia.sources.exports import SourceTable

# Sources and tables that are written at the same time.
AT_ONCE = 4

USAGE = "table string, key_role string, attempted bigint, resolved bigint, missed bigint"
LOSSES = "table string, source_rows bigint, kept_rows bigint, lost_rows bigint, row_count bigint"


@dataclass(frozen=True)
class TableRun:
    """Written tables, key usage by table and role, and rows read, kept, lost and written by table."""

    tables: dict[str, DataFrame]
    usage: DataFrame
    losses: DataFrame


@dataclass(frozen=True)
class _Source:
    """A source, the tables it feeds, and its rows with resolved keys."""

    table: SourceTable
    specs: list[TableSpec]
    frame: DataFrame
    readers: dict[str, RowReader]

    @classmethod
    def of(cls, table: SourceTable, specs: list[TableSpec], maps: Mapping[str, EntityMap], context: JoinContext, settings: Settings) -> _Source:
        frame = table.df
        roles = {WORKER_ROLE: ("_worker", any(s.worker for s in specs)), SITE_ROLE: ("_site", any(s.site for s in specs))}
        for role, (out, needed) in roles.items():
            if needed:
                frame = context.resolve(frame, table, role, None, out)

        def key(out: str, own: str | None) -> Column:
            # Each table falls back to its own column where no rule knows the key.
            if f"{out}_resolved" not in frame.columns:
                return table.cell(own)
            return F.when(F.col(f"{out}_resolved"), F.col(out)).otherwise(table.cell(own))

        readers = {}
        for spec in specs:
            r = row_reader(spec, table, maps, settings)
            readers[spec.name] = replace(
                r, worker=key("_worker", r.own.get("travailleur_id")), site=key("_site", r.own.get("etablissement_id"))
            )
        return cls(table, specs, frame, readers)

    def kept(self, spec: TableSpec) -> Column:
        return not_empty(spec.required(self.readers[spec.name]))

    def roles(self, spec: TableSpec) -> list[tuple[str, str, Column]]:
        """(role, resolved column, rows whose key is looked up) of a table, where rules exist."""
        every = F.lit(True)
        found = [(WORKER_ROLE, "_worker_resolved", every)] if spec.worker else []
        if spec.site:
            found.append((SITE_ROLE, "_site_resolved", self.kept(spec) if spec.site_after_filter else every))
        return [x for x in found if x[1] in self.frame.columns]

    def metrics(self) -> list[Column]:
        """Counts of one pass over the rows."""
        found = [F.count(F.lit(1)).alias("rows")]
        for spec in self.specs:
            found.append(F.count_if(self.kept(spec)).alias(f"{spec.name} kept"))
            for role, resolved, looked_up in self.roles(spec):
                found.append(F.count_if(looked_up).alias(f"{spec.name} {role} attempted"))
                found.append(F.count_if(looked_up & F.col(resolved)).alias(f"{spec.name} {role} resolved"))
        return found

    def columns(self) -> list[str]:
        """The cells and keys that the tables read."""
        fields = {c for r in self.readers.values() for c in r.own.values() if c in self.table.columns}
        cells = [f"c_{k}" for k, name in enumerate(self.table.columns) if name in fields]
        return ["ordinal", *cells, *(c for c in self.frame.columns if c.startswith(("_worker", "_site")))]


def run_tables(
    spark: SparkSession, maps: Mapping[str, EntityMap], context: JoinContext, settings: Settings, output: str
) -> TableRun:
    """Builds and writes all standard tables below ``output``; an entity that is not mapped gives an empty table."""
    groups: dict[str, list[TableSpec]] = {}
    for spec in SPECS:
        if spec.name in maps:
            groups.setdefault(maps[spec.name].source_ref, []).append(spec)
    usage, losses, counts = [], {}, {}

    def write(df: DataFrame, path: str, metrics: list[Column]) -> dict:
        seen = Observation()
        df.observe(seen, *metrics).write.mode("overwrite").parquet(path)
        return seen.get

    def write_source(number: int, ref: str) -> list[tuple[TableSpec, DataFrame, RowReader]]:
        source = _Source.of(context.sources[ref], groups[ref], maps, context, settings)
        place = f"{output}/_resolved/{number}"
        seen = Observation()
        source.frame.observe(seen, *source.metrics()).select(*source.columns()).write.mode("overwrite").parquet(place)
        got = seen.get
        rows = spark.read.parquet(place)
        for spec in source.specs:
            losses[spec.name] = (got["rows"], got[f"{spec.name} kept"])
            for role, _, _ in source.roles(spec):
                attempted, resolved = (got[f"{spec.name} {role} {x}"] for x in ("attempted", "resolved"))
                usage.append((spec.name, role, attempted, resolved, attempted - resolved))
        return [(spec, rows.where(source.kept(spec)), source.readers[spec.name]) for spec in source.specs]

    def write_table(job: tuple[TableSpec, DataFrame]) -> None:
        spec, built = job
        counts[spec.name] = write(built, f"{output}/{spec.name}", [F.count(F.lit(1)).alias("n")])["n"]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        jobs = [job for made in pool.map(write_source, range(len(groups)), groups) for job in made]
        built = [(spec, finish_table(spec, rows, r)) for spec, rows, r in jobs]
        built += [(spec, build_table(spark, spec, maps, context, settings)) for spec in SPECS if spec.name not in maps]
        list(pool.map(write_table, built))
    lost = [
        (spec.name, read, kept, read - kept, counts[spec.name]) for spec in SPECS for read, kept in [losses.get(spec.name, (0, 0))]
    ]
    return TableRun(
        {spec.name: spark.read.parquet(f"{output}/{spec.name}") for spec in SPECS},
        spark.createDataFrame(usage, USAGE), spark.createDataFrame(lost, LOSSES),
    )
