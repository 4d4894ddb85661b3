"""From exports to tables and cohorts: expected counts, review, registry, privacy."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from harmonia.operators.cohort import evaluate_cohort
from harmonia.operators.key_resolution import JoinContext
from harmonia.operators.registry import load_registry
from harmonia.operators.review import Decisions
from harmonia.operators.standard_tables import NORMALIZED_COLUMNS, Settings, build_tables, public_columns
from harmonia.plans.mapping_document import review_queue
from harmonia.plans.workflow import apply_review, propose, review_base, transform
from tests.exports import COHORTS, S4_VALUES, S4_WORDS, write_exports

SYSTEM = {"source_system": "ACCEPTANCE", "schema_version": "model-v0.1", "exact_overlap": False}
SALT = "test-salt"
SETTINGS = Settings(salt=SALT, reference_year=2026)


def approve(queue, spark, kinds=("columns", "values", "rules")):
    columns = [{"id": r["id"], "action": "approve", "reviewer": "r", "reason": "ok"} for r in queue.columns.collect()]
    values = [
        {"id": r["id"], "action": "approve", "target_value": r["target_value"], "reviewer": "r"}
        for r in queue.values.where("suggested_action = 'review'").collect()
    ]
    rules = [{"id": r["id"], "action": "approve", "reviewer": "r"} for r in queue.rules.collect()]
    return Decisions.from_rows(
        spark, columns if "columns" in kinds else (), values if "values" in kinds else (), rules if "rules" in kinds else ()
    )


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    exports = write_exports(root / "exports")
    proposed = propose(spark, str(exports), str(root / "work"), **SYSTEM)
    reviewed = apply_review(
        spark, str(root / "work"), approve(proposed.queue, spark, ("columns",)), registry_dir=str(root / "registry"),
        now=datetime(2026, 1, 2),
    )
    done = transform(spark, reviewed.mapping, proposed.bronze, str(root / "tables"), SETTINGS)
    return root, proposed, reviewed, done


def test_proposal_counts(run):
    _, proposed, _, _ = run
    mapping = proposed.mapping
    assert mapping.entities.count() == 13
    assert mapping.blocked.count() == 6
    assert mapping.join_candidates.count() == 31
    assert mapping.review_queue.count() == 2
    rules = mapping.join_rules
    assert rules.count() == 31
    assert {r["status"]: r["count"] for r in rules.groupBy("status").count().collect()} == {"auto_validable": 12, "a_revoir": 19}
    assert mapping.alternates.count() == 1


def test_join_rules(run):
    rules = run[1].mapping.join_rules

    def rule(primary, foreign, column):
        return rules.where(
            (F.col("primary.source_ref") == primary) & (F.col("foreign.source_ref") == foreign) & (F.col("primary.column") == column)
        ).first()

    worker = rule("export_01_individus.csv", "export_03_actes.csv", "ClePers")
    assert (worker["key_role"], worker["join_type"], worker["cardinality"]) == ("travailleur_id", "primary_foreign_key", "one_to_one")
    company = rule("export_02_structures.csv", "export_01_individus.csv", "CleAdh")
    assert (company["key_role"], company["cardinality"]) == ("entreprise_id", "one_to_many")
    peer = rules.where("left.source_ref = 'export_03_actes.csv' and right.source_ref = 'export_04_risques.csv'").first()
    assert peer["join_type"] == "peer_key_overlap" and peer["primary"] is None and peer["foreign"] is None
    assert peer["id"] == hashlib.sha1(b"export_03_actes.csv|ClePers|export_04_risques.csv|ClePers").hexdigest()[:12]


def test_exact_overlap_agrees_on_small_columns(spark, run):
    from harmonia.operators import profiling, source_graph

    _, proposed, _, _ = run
    counts = profiling.value_counts(proposed.bronze.sources().values())
    exact = source_graph.join_candidates(proposed.profiles.columns, proposed.profiles.sources, counts)
    key = ["left.source_ref", "left.column", "right.source_ref", "right.column", "confidence_score"]
    assert sorted(map(tuple, exact.select(*[F.col(k) for k in key]).collect())) == sorted(
        map(tuple, proposed.mapping.join_candidates.select(*[F.col(k) for k in key]).collect())
    )
    plan = exact._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_table_counts_and_quality(run):
    _, _, reviewed, done = run
    counts = {r["table"]: r["row_count"] for r in done.row_counts.collect()}
    assert counts.pop("entreprise") == 3 and counts.pop("etablissement") == 3
    assert len(counts) == 11 and set(counts.values()) == {4}
    usage = done.usage.agg(F.sum("attempted"), F.sum("resolved"), F.sum("missed")).first()
    assert tuple(usage) == (40, 40, 0)
    assert reviewed.mapping.review_queue.count() == 0
    assert reviewed.mapping.mapping_version == "0.1.0-draft-reviewed"
    assert reviewed.mapping.value_groups.count() == 11
    rules = {r["rule"]: r for r in done.quality.collect()}
    assert len(rules) == 13 + 13 + 9
    assert rules["review_queue:pending_value_mappings"]["status"] == "failed"
    assert rules["review_queue:pending_value_mappings"]["message"].startswith("4 nomenclature values")
    assert rules["source_graph:join_resolution"]["status"] == "passed"
    assert rules["source_graph:join_resolution"]["message"].startswith("40/40 key values resolved")
    assert rules["source_graph:explicit_join_rules"]["message"] == "31 explicit join rules generated; 19 require review."
    assert rules["sensitivity:S4_blocked"]["message"].startswith("6 S4 fields")
    assert all(r["status"] == "passed" for name, r in rules.items() if name.startswith(("required", "mapping_source", "join_coverage")))


def test_usable_rules_and_resolution(spark, run):
    _, proposed, reviewed, _ = run
    sources = proposed.bronze.sources()
    context = JoinContext.build(sources, reviewed.mapping.join_rules)
    assert len(context.rules) == 11
    duerp = sources["export_09_duerp.csv"]
    got = context.resolve(duerp.df, duerp, "etablissement_id", "Site", "_site").orderBy("ordinal").first()
    assert got["_site"] == "E10" and got["_site_resolved"]


def pseudonym(prefix, value):
    return f"{prefix}_" + hashlib.sha256(f"{SALT}|{value}".encode()).hexdigest()[:10]


def test_table_contents(run):
    tables = run[3].tables
    workers = {r["travailleur_id"]: r for r in tables["travailleur"].collect()}
    first = workers[pseudonym("T", "S001")]
    assert (first["annee_naissance"], first["age_classe"], first["sexe"], first["suivi_type_concept_id"]) == (1974, "AGE_45_54", "F", "SIA")
    site = {r["etablissement_id"]: r for r in tables["etablissement"].collect()}[pseudonym("ET", "E10")]
    assert site["entreprise_id"] == pseudonym("E", "A100") and site["taille_classe"] == "ETI_50_249"
    visit = {r["visite_id"]: r for r in tables["visite_sante_travail"].collect()}[pseudonym("V", "S001|2024-02-12|VR")]
    assert visit["type_visite_concept_id"] == "REPRISE" and str(visit["date_visite"]) == "2024-02-12"
    assert visit["motif_visite_concept_id"] == "AT_30_JOURS"
    conclusion = {r["visite_id"]: r for r in tables["conclusion_medicale"].collect()}
    assert conclusion[visit["visite_id"]]["conclusion_id"] == pseudonym("C", "S001|2024-02-12|apte avec restrictions")
    assert conclusion[visit["visite_id"]]["restriction_flag"] is True
    assert sum(r["orientation_pdp_flag"] for r in conclusion.values()) == 1
    unit = {r["unite_travail_id"] for r in tables["unite_travail"].collect()}
    assert pseudonym("UT", "E10|Bionettoyage") in unit
    assert {r["unite_travail_id"] for r in tables["episode_poste"].collect()} == unit
    assert {r["unite_travail_id"] for r in tables["risque_unite_travail"].collect()} == unit
    assert pseudonym("X", "S001|Manutention patients|1") in {r["exposition_id"] for r in tables["exposition_professionnelle"].collect()}
    assert pseudonym("AR", "S001|2024-01-12|1") in {r["arret_travail_id"] for r in tables["arret_travail"].collect()}
    assert [f.dataType.simpleString() for f in tables["arret_travail"].schema if f.name in ("date_debut", "lie_atmp_flag")] == ["date", "boolean"]


def test_text_tables_keep_source_text(spark, run):
    _, proposed, reviewed, _ = run
    context = JoinContext.build(proposed.bronze.sources(), reviewed.mapping.join_rules)
    built = build_tables(
        spark, reviewed.mapping.entity_maps(), context, Settings(salt=SALT, reference_year=2026, typed=False)
    )
    row = public_columns(built["arret_travail"]).orderBy("date_debut").first().asDict()
    assert row["date_debut"] == "2023-10-01" and row["lie_atmp_flag"] == "false" and "row_ordinal" not in row
    assert built["conclusion_medicale"].where("inaptitude_flag = 'false'").count() == 4


def test_no_sensitive_value_in_tables(run):
    for name, df in run[3].tables.items():
        assert not set(S4_WORDS) & set(df.columns)
        content = " ".join(str(v) for row in df.collect() for v in row)
        for value in S4_VALUES:
            assert value not in content, (name, value)


@pytest.mark.parametrize(
    "name, ladder, records, pairs",
    [("handling_45_plus", [4, 3, 3, 1], [], None), ("handling_before_restriction", [4, 3, 1], [1, 2], 1),
     ("stop_before_return", [4, 3, 1], [2, 1], 1)],
)
def test_cohorts(spark, run, name, ladder, records, pairs):
    result = evaluate_cohort(spark, run[3].tables, COHORTS[name], normalized_columns=NORMALIZED_COLUMNS, materialize=True)
    assert [r["output_count"] for r in result.steps.orderBy("ord").collect()] == ladder
    assert [r["records_count"] for r in result.events.collect()] == records
    assert [r["matched_pairs_count"] for r in result.sequences.collect()] == ([pairs] if pairs else [])
    assert [r[0] for r in result.included.collect()] == [pseudonym("T", "S001")]
    summary = result.summary.first()
    assert summary["feasibility_status"] == "feasible" and summary["diagnostics_count"] == 0
    plain = evaluate_cohort(spark, run[3].tables, COHORTS[name])
    assert [r["output_count"] for r in plain.steps.orderBy("ord").collect()] == ladder


def test_review_is_idempotent_and_registry_learns(spark, run, tmp_path):
    root, proposed, reviewed, _ = run
    registry = load_registry(spark, str(root / "registry"))
    assert {(r["source_column"], r["entity"], r["target_field"], r["decision_count"]) for r in registry.collect()} == {
        ("Adaptation", "conclusion_medicale", "amenagement_flag", 1), ("Reserve", "conclusion_medicale", "restriction_flag", 1)}

    again = propose(spark, str(root / "exports"), str(tmp_path / "second"), registry_dir=str(root / "registry"), **SYSTEM)
    assert again.mapping.review_queue.count() == 0
    flags = {r["target_field"]: r for r in again.mapping.fields.where("entity = 'conclusion_medicale'").collect()}
    for field in ("restriction_flag", "amenagement_flag"):
        assert flags[field]["review_status"] == "validated_by_registry" and flags[field]["confidence_score"] == 0.995
    assert again.queue.values.select("group_id").distinct().count() == 4

    work = str(tmp_path / "second")
    everything = apply_review(spark, work, approve(again.queue, spark))
    assert review_queue(everything.mapping).pending_ids().count() == 0
    assert everything.mapping.join_rules.where("status = 'validated_by_human_review'").count() == 19
    empty = apply_review(spark, work, Decisions.from_rows(spark))
    assert review_queue(empty.mapping).pending_ids().count() == 0
    assert empty.mapping.value_items.where("status = 'validated_by_human_review'").count() == 4
    assert empty.mapping.mapping_version == "0.1.0-draft-reviewed"
    assert review_base(spark, work).review_status == "reviewed"


def test_two_learners_at_once_keep_both_decisions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from harmonia.operators import registry

    def learned(column, year):
        values = {"id": column, "source_column": column, "decision_count": 1, "first_learned_at": datetime(year, 1, 1), "last_learned_at": datetime(year, 1, 1)}
        row = {part.split()[0]: values.get(part.split()[0]) for part in registry.SCHEMA.split(", ")}
        return spark.createDataFrame([row], registry.SCHEMA)

    folder = str(tmp_path / "registry")
    assert registry.learn(learned("a", 2024), folder) == 1
    # One that still holds the first snapshot as its base comes second.
    assert registry.publish(registry.merge_entries(load_registry(spark, folder, 1), learned("b", 2025)), folder, 2)
    assert not registry.publish(registry.merge_entries(load_registry(spark, folder, 1), learned("c", 2025)), folder, 2)
    assert registry.learn(learned("c", 2025), folder) == 3
    with ThreadPoolExecutor(3) as pool:
        numbers = list(pool.map(lambda k: registry.learn(learned(f"d{k}", 2026), folder), range(3)))
    assert sorted(numbers) == [4, 5, 6]
    held = {r["id"]: r["decision_count"] for r in load_registry(spark, folder).collect()}
    assert held == {"a": 1, "b": 1, "c": 1, "d0": 1, "d1": 1, "d2": 1}
    assert [r["id"] for r in load_registry(spark, folder, 1).collect()] == ["a"]
    registry.prune(spark, folder, 2)
    assert registry.snapshots(spark, folder) == [5, 6]
