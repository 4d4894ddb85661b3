"""The standard tables, built from mapped sources by one builder and a list of specifications."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonia.fixed_values import SOURCE_ID
from harmonia.functions.keys import hash_id
from harmonia.functions.text import normalize, normalize_upper
from harmonia.functions.values import (
    age_class,
    classify_size,
    exposure_category,
    flag,
    normalize_conclusion,
    normalize_exposure,
    normalize_sex,
    normalize_visit_type,
    number,
    parse_date,
)
from harmonia.operators.key_resolution import JoinContext
from harmonia.operators.skew import last_row_wins
from harmonia.sources.exports import SourceTable

WORKER_ROLE, SITE_ROLE = "travailleur_id", "etablissement_id"


@dataclass(frozen=True)
class EntityMap:
    """Where the fields of an entity come from."""

    source_ref: str
    fields: Mapping[str, str]


@dataclass(frozen=True)
class Settings:
    """Choices of a build: the pseudonym salt and length, the year that ages refer to."""

    salt: str
    reference_year: int
    hash_length: int = 10
    typed: bool = True

    def id(self, prefix: str, *parts: Column) -> Column:
        return hash_id(prefix, *parts, salt=self.salt, length=self.hash_length)

    def id_or_empty(self, prefix: str, guard: Column, *parts: Column) -> Column:
        return F.when(guard != "", self.id(prefix, *parts)).otherwise("")


@dataclass(frozen=True)
class RowReader:
    """Cells of one source row by target field; resolved keys as ``worker`` and ``site``."""

    table: SourceTable
    own: Mapping[str, str]
    settings: Settings
    worker: Column = field(default_factory=lambda: F.col("_worker"))
    site: Column = field(default_factory=lambda: F.col("_site"))
    ordinal: Column = field(default_factory=lambda: F.col("ordinal"))

    def raw(self, name: str) -> Column:
        return self.table.cell(self.own.get(name))

    def upper(self, name: str) -> Column:
        return normalize_upper(self.raw(name))

    def date(self, name: str) -> Column:
        return parse_date(self.raw(name)) if self.settings.typed else self.raw(name)

    def flag(self, value: Column) -> Column:
        return value if self.settings.typed else value.cast("string")

    def id(self, prefix: str, *parts: Column) -> Column:
        return self.settings.id(prefix, *parts)


Build = Callable[[RowReader], dict[str, Column]]


@dataclass(frozen=True)
class TableSpec:
    """One standard table.

    ``keys`` names the resolved keys the table needs, ``required`` the values
    that may not be empty, ``build`` its columns with the id first.  ``fields_of``
    lends the mapping of another entity where a table reads that entity's fields.
    """

    name: str
    level: str
    required: Callable[[RowReader], list[Column]]
    build: Build
    worker: bool = False
    site: bool = False
    site_after_filter: bool = False
    unique: bool = False
    fields_of: str | None = None


def _typed_year(r: RowReader) -> Column:
    year = r.raw("annee_naissance")
    return F.trim(year).try_cast("int") if r.settings.typed else year


def _typed_number(r: RowReader, name: str) -> Column:
    return number(r.raw(name)) if r.settings.typed else r.raw(name)


def _company(r: RowReader) -> dict[str, Column]:
    return {
        "secteur_naf": r.raw("secteur_naf"),
        "taille_classe": classify_size(r.raw("taille_classe")),
        "region": r.raw("region"),
    }


def _visit_id(r: RowReader) -> Column:
    return r.id("V", r.worker, r.raw("date_visite"), r.raw("type_visite_concept_id"))


def _worker_id(r: RowReader) -> dict[str, Column]:
    return {"travailleur_id": r.id("T", r.worker)}


def _worker_fact(name: str, id_column: str, prefix: str, parts: list[str], build: Build) -> TableSpec:
    """A dated fact of a worker whose id also takes the row ordinal."""
    return TableSpec(
        name, "S3",
        lambda r: [r.worker, *[r.raw(p) for p in parts]],
        lambda r: {id_column: r.id(prefix, r.worker, *[r.raw(p) for p in parts], r.ordinal), **_worker_id(r), **build(r)},
        worker=True,
    )


def _unit_label(r: RowReader) -> Column:
    mapped = r.own.get("libelle_unite_source")
    return r.raw("libelle_unite_source") if mapped in r.table.columns else r.raw("unite_travail_id")


SPECS: tuple[TableSpec, ...] = (
    TableSpec(
        "travailleur", "S3", lambda r: [r.raw("travailleur_id")],
        lambda r: {
            "travailleur_id": r.id("T", r.raw("travailleur_id")),
            "annee_naissance": _typed_year(r),
            "age_classe": age_class(r.raw("annee_naissance"), r.settings.reference_year),
            "sexe": normalize_sex(r.raw("sexe")),
            "suivi_type_concept_id": r.upper("suivi_type_concept_id"),
        },
        unique=True,
    ),
    TableSpec(
        "entreprise", "S1", lambda r: [r.raw("entreprise_id")],
        lambda r: {"entreprise_id": r.id("E", r.raw("entreprise_id")), **_company(r)},
        unique=True,
    ),
    TableSpec(
        "etablissement", "S1", lambda r: [r.raw("etablissement_id")],
        lambda r: {
            "etablissement_id": r.id("ET", r.raw("etablissement_id")),
            "entreprise_id": r.settings.id_or_empty("E", r.raw("entreprise_id"), r.raw("entreprise_id")),
            **_company(r),
        },
        unique=True,
    ),
    TableSpec(
        "unite_travail", "S2", lambda r: [r.raw("unite_travail_id")],
        lambda r: {
            "unite_travail_id": r.id("UT", r.site, r.raw("unite_travail_id")),
            "etablissement_id": r.settings.id_or_empty("ET", r.site, r.site),
            "libelle_unite_source": _unit_label(r),
            "unite_travail_concept_id": r.upper("unite_travail_id"),
        },
        site=True, unique=True,
    ),
    TableSpec(
        "episode_poste", "S2", lambda r: [r.worker, r.raw("intitule_poste_source")],
        lambda r: {
            "episode_poste_id": r.id("EP", r.worker, r.raw("intitule_poste_source"), r.ordinal),
            **_worker_id(r),
            "etablissement_id": r.settings.id_or_empty("ET", r.site, r.site),
            "unite_travail_id": r.settings.id_or_empty("UT", r.raw("unite_travail_id"), r.site, r.raw("unite_travail_id")),
            "intitule_poste_source": r.raw("intitule_poste_source"),
            "poste_concept_id": r.upper("intitule_poste_source"),
            "date_debut": r.date("date_debut"),
            "date_fin": r.date("date_fin"),
        },
        worker=True, site=True, site_after_filter=True,
    ),
    TableSpec(
        "visite_sante_travail", "S3", lambda r: [r.worker, r.raw("date_visite")],
        lambda r: {
            "visite_id": _visit_id(r),
            **_worker_id(r),
            "date_visite": r.date("date_visite"),
            "type_visite_concept_id": normalize_visit_type(r.raw("type_visite_concept_id")),
            "motif_visite_concept_id": r.upper("motif_visite_concept_id"),
            "professionnel_role": r.raw("professionnel_role"),
        },
        worker=True,
    ),
    TableSpec(
        "conclusion_medicale", "S3", lambda r: [r.worker, r.raw("date_visite")],
        lambda r: {
            "conclusion_id": r.id("C", r.worker, r.raw("date_visite"), r.raw("conclusion_concept_id")),
            "visite_id": _visit_id(r),
            "conclusion_concept_id": normalize_conclusion(r.raw("conclusion_concept_id")),
            "restriction_flag": r.flag(flag(r.raw("restriction_flag"))),
            "amenagement_flag": r.flag(flag(r.raw("amenagement_flag"))),
            "inaptitude_flag": r.flag(F.lit(False)),
            "orientation_pdp_flag": r.flag(normalize(r.raw("conclusion_concept_id")).contains("pdp")),
        },
        worker=True, fields_of="visite_sante_travail",
    ),
    _worker_fact(
        "exposition_professionnelle", "exposition_id", "X", ["exposition_concept_id"],
        lambda r: {
            "exposition_concept_id": normalize_exposure(r.raw("exposition_concept_id")),
            "categorie_exposition": exposure_category(r.raw("exposition_concept_id")),
            "niveau_classe": r.upper("niveau_classe"),
            "date_debut": r.date("date_debut"),
            "date_fin": r.date("date_fin"),
            "source_exposition_type": r.upper("source_exposition_type"),
        },
    ),
    _worker_fact(
        "examen_complementaire", "examen_id", "EX", ["date_examen", "examen_type_concept_id"],
        lambda r: {
            "date_examen": r.date("date_examen"),
            "examen_type_concept_id": r.upper("examen_type_concept_id"),
            "resultat_valeur": _typed_number(r, "resultat_valeur"),
            "resultat_unite": r.raw("resultat_unite"),
            "interpretation_concept_id": r.upper("interpretation_concept_id"),
        },
    ),
    _worker_fact(
        "pathologie_atmp", "pathologie_atmp_id", "PA", ["date_evenement", "type_evenement"],
        lambda r: {
            "date_evenement": r.date("date_evenement"),
            "type_evenement": r.upper("type_evenement"),
            "code_cim10": r.upper("code_cim10"),
            "pathologie_concept_id": r.upper("pathologie_concept_id"),
            "reconnaissance_flag": r.flag(flag(r.raw("reconnaissance_statut"))),
        },
    ),
    _worker_fact(
        "arret_travail", "arret_travail_id", "AR", ["date_debut"],
        lambda r: {
            "date_debut": r.date("date_debut"),
            "date_fin": r.date("date_fin"),
            "type_arret": r.upper("type_arret"),
            "lie_atmp_flag": r.flag(flag(r.raw("lie_atmp_flag"))),
        },
    ),
    _worker_fact(
        "vaccination", "vaccination_id", "VAC", ["vaccin_concept_id"],
        lambda r: {
            "vaccin_concept_id": r.upper("vaccin_concept_id"),
            "date_vaccination": r.date("date_vaccination"),
            "statut_vaccinal": r.upper("statut_vaccinal"),
            "rappel_prevu": r.date("rappel_prevu"),
        },
    ),
    TableSpec(
        "risque_unite_travail", "S3", lambda r: [r.site, r.raw("unite_travail_id"), r.raw("risque_concept_id")],
        lambda r: {
            "risque_unite_travail_id": r.id(
                "RUT", r.site, r.raw("unite_travail_id"), r.raw("risque_concept_id"), r.ordinal
            ),
            "etablissement_id": r.id("ET", r.site),
            "unite_travail_id": r.id("UT", r.site, r.raw("unite_travail_id")),
            "risque_concept_id": normalize_exposure(r.raw("risque_concept_id")),
            "niveau_risque": r.upper("niveau_risque"),
            "mesure_prevention_source": r.raw("mesure_prevention_source"),
            "date_evaluation": r.date("date_evaluation"),
        },
        site=True,
    ),
)
SPEC_BY_NAME = {spec.name: spec for spec in SPECS}

# Columns that the builder writes in normalised upper-case form; the cohort
# engine compares them directly, so the comparison reaches the Parquet scan.
NORMALIZED_COLUMNS = frozenset(
    {
        "travailleur.sexe", "travailleur.suivi_type_concept_id", "episode_poste.poste_concept_id",
        "visite_sante_travail.type_visite_concept_id", "visite_sante_travail.motif_visite_concept_id",
        "conclusion_medicale.conclusion_concept_id", "exposition_professionnelle.exposition_concept_id",
        "exposition_professionnelle.categorie_exposition", "exposition_professionnelle.niveau_classe",
        "exposition_professionnelle.source_exposition_type", "examen_complementaire.examen_type_concept_id",
        "examen_complementaire.interpretation_concept_id", "pathologie_atmp.type_evenement",
        "pathologie_atmp.code_cim10", "pathologie_atmp.pathologie_concept_id", "arret_travail.type_arret",
        "vaccination.vaccin_concept_id", "vaccination.statut_vaccinal",
        "risque_unite_travail.risque_concept_id", "risque_unite_travail.niveau_risque",
    }
)


def row_reader(spec: TableSpec, table: SourceTable, maps: Mapping[str, EntityMap], settings: Settings) -> RowReader:
    own = dict(maps[spec.name].fields)
    if spec.fields_of:
        lent = maps.get(spec.fields_of)
        own = {**(dict(lent.fields) if lent else {}), **own}
    return RowReader(table, own, settings)


def not_empty(columns: list[Column]) -> Column:
    condition = F.lit(True)
    for column in columns:
        condition = condition & (column != "")
    return condition


def build_table(
    spark: SparkSession, spec: TableSpec, maps: Mapping[str, EntityMap], context: JoinContext, settings: Settings
) -> DataFrame:
    """One standard table; an entity that is not mapped gives an empty table."""
    if spec.name not in maps:
        empty = SourceTable("", (), spark.createDataFrame([], "ordinal bigint"))
        table, maps = empty, {**maps, spec.name: EntityMap("", {})}
    else:
        table = context.sources[maps[spec.name].source_ref]
    r = row_reader(spec, table, maps, settings)
    frame = table.df
    if spec.worker:
        frame = context.resolve(frame, table, WORKER_ROLE, r.own.get("travailleur_id"), "_worker")
    if spec.site and not spec.site_after_filter:
        frame = context.resolve(frame, table, SITE_ROLE, r.own.get("etablissement_id"), "_site")
    frame = frame.where(not_empty(spec.required(r)))
    if spec.site_after_filter:
        frame = context.resolve(frame, table, SITE_ROLE, r.own.get("etablissement_id"), "_site")
    return finish_table(spec, frame, r)


def finish_table(spec: TableSpec, frame: DataFrame, r: RowReader) -> DataFrame:
    """The table's columns from rows that have its keys and required values."""
    built = frame.select(
        *[column.alias(name) for name, column in spec.build(r).items()],
        F.lit(spec.level).alias("sensitivity_level"),
        F.lit(SOURCE_ID).alias("source_id"),
        F.col("ordinal").alias("row_ordinal"),
    )
    if spec.unique:
        built = last_row_wins(built, [built.columns[0]], F.col("row_ordinal"))
        built = built.drop("row_ordinal").withColumnRenamed("first_order", "row_ordinal")
    return built


def build_tables(
    spark: SparkSession, maps: Mapping[str, EntityMap], context: JoinContext, settings: Settings
) -> dict[str, DataFrame]:
    """All standard tables, in their fixed order."""
    return {spec.name: build_table(spark, spec, maps, context, settings) for spec in SPECS}


def resolution_usage(maps: Mapping[str, EntityMap], context: JoinContext, settings: Settings) -> DataFrame | None:
    """Keys looked up, found and missed by table and key role."""
    parts = []
    for spec in SPECS:
        if spec.name not in maps:
            continue
        table = context.sources[maps[spec.name].source_ref]
        r = row_reader(spec, table, maps, settings)
        roles = [(WORKER_ROLE, None)] if spec.worker else []
        if spec.site:
            roles.append((SITE_ROLE, spec if spec.site_after_filter else None))
        for role, after in roles:
            source = table
            if after is not None:
                kept = context.resolve(table.df, table, WORKER_ROLE, r.own.get("travailleur_id"), "_worker")
                source = SourceTable(table.source_ref, table.columns, kept.where(not_empty(after.required(r))))
            used = context.usage(source, role)
            if used is not None:
                parts.append(used.select(F.lit(spec.name).alias("table"), "*"))
    whole = None
    for part in parts:
        whole = part if whole is None else whole.unionByName(part)
    return whole


def public_columns(df: DataFrame) -> DataFrame:
    """The documented columns, without the technical row ordinal."""
    return df.drop("row_ordinal")
