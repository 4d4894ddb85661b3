"""Sequences against brute force, predicates, and the shapes of a result."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from harmonia.operators.cohort import Reader, evaluate_cohort, event_predicate
from harmonia.operators.sequences import sequence_pairs
from harmonia.plans.cohort_definition import CohortDefinition, SequenceDefinition


def brute(first, then, relation, low, high, compat=False):
    total = 0
    low = 0 if low is None else low
    if relation == "same_day" and high is None and not compat:
        high = 0
    if relation == "strictly_before" and low == 0:
        low = 1
    for a in first:
        for b in then:
            gap = (b - a).days
            delta = abs(gap) if relation == "same_day" else -gap if relation == "after" else gap
            total += delta >= low and (high is None or delta <= high)
    return total


@pytest.mark.parametrize("compat", [False, True])
def test_sequence_pairs_match_brute_force(spark, compat):
    rng = random.Random(3)
    start = date(2024, 1, 1)
    events = {
        w: {e: [start + timedelta(rng.randrange(40)) for _ in range(rng.choice([0, 1, 5, 20]))] for e in "ab"}
        for w in ("w1", "w2", "w3", "hot")
    }
    events["hot"]["a"] += [start] * 200  # one worker holds most rows
    rows = [(w, d, e) for w, by in events.items() for e, ds in by.items() for d in ds]
    days = (
        spark.createDataFrame(rows, "travailleur_id string, event_date date, e string")
        .groupBy("travailleur_id", "event_date")
        .agg(F.count_if(F.col("e") == "a").alias("n_a"), F.count_if(F.col("e") == "b").alias("n_b"))
    )
    cases = [
        (relation, low, high)
        for relation in ("before", "strictly_before", "after", "same_day", "anything")
        for low in (None, 0, 3, -2)
        for high in (None, 0, 5, -1)
    ]
    sequences = tuple(
        SequenceDefinition(f"s{i}", "", "a", "b", relation, low, high) for i, (relation, low, high) in enumerate(cases)
    ) + (SequenceDefinition("self", "", "a", "a", "before", None, None), SequenceDefinition("none", "", "a", "zz", "before", None, None))
    got = {r["travailleur_id"]: r for r in sequence_pairs(days, sequences, {"a": "n_a", "b": "n_b"}, compat).collect()}
    for w, by in events.items():
        if w not in got:
            assert not by["a"] and not by["b"]
            continue
        for i, (relation, low, high) in enumerate(cases):
            assert int(got[w][f"pairs_{i}"]) == brute(by["a"], by["b"], relation, low, high, compat), (w, relation, low, high)
        assert int(got[w][f"pairs_{len(cases)}"]) == brute(by["a"], by["a"], "before", None, None)
        assert int(got[w][f"pairs_{len(cases) + 1}"]) == 0


def test_no_pairs_are_built(spark):
    days = spark.createDataFrame([], "travailleur_id string, event_date date, n_a bigint, n_b bigint")
    plan = sequence_pairs(
        days, (SequenceDefinition("s", "", "a", "b", "before", 0, 30),), {"a": "n_a", "b": "n_b"}
    )._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" in plan


def test_event_predicates(spark):
    df = spark.createDataFrame([("Oui",), ("non",), ("1",), ("Très haut",), (None,)], "v string")
    reader = Reader({"t": df})

    def hits(expected, column="v"):
        return [r[0] for r in df.select(event_predicate(reader, "t", {column: expected})).collect()]

    assert hits(True) == [True, False, True, False, False]
    assert hits("tres-haut") == [False, False, False, True, False]
    assert hits(["non", "tres haut"]) == [False, True, False, True, False]
    assert hits({"not_any": ["oui"]}) == [False, True, False, True, True]
    assert hits({"equals": False}) == [False, True, False, False, False]
    assert hits({"any": ["non"], "equals": "oui"}) == [False, True, False, False, False]
    assert hits({"unknown": 1}) == [False] * 5
    assert hits("", "absent") == [True] * 5
    assert hits([]) == [False] * 5
    flags = spark.createDataFrame([(True,), (False,), (None,)], "v boolean")
    reader = Reader({"t": flags})
    assert [r[0] for r in flags.select(event_predicate(reader, "t", {"v": "oui"})).collect()] == [True, False, False]
    assert [r[0] for r in flags.select(event_predicate(reader, "t", {"v": {"not_any": [True]}})).collect()] == [False, True, True]
    plain = Reader({"t": df}, ("t.v",))
    assert [r[0] for r in df.select(event_predicate(plain, "t", {"v": "OUI"})).collect()][1:] == [False, True, False, False]


def test_definition_parsing():
    definition = CohortDefinition.from_dict({
        "criteria": {"exposures": {"any": ["bruit"]}, "visit_types": "vr", "flags": {"restriction_flag": True}},
        "longitudinal": {"events": {"e": {"table": "conclusion_medicale"}, "bad": 3},
                         "sequences": {"s": {"before": "e", "after": "f", "max_days": "3"}}},
    })
    assert definition.exposures == ("BRUIT",) and definition.visit_types == ("VR",)
    assert definition.events[0].linked and definition.events[0].date_column == "date_visite"
    assert definition.sequences[0].first == "e" and definition.sequences[0].max_days == 3
    assert definition.required_tables() == [
        "conclusion_medicale", "exposition_professionnelle", "travailleur", "visite_sante_travail"]
    assert definition.required_fields()["conclusion_medicale"] == ["restriction_flag", "visite_id"]


def test_missing_table_and_empty_result(spark, tmp_path):
    workers = spark.createDataFrame([("a", "1970"), ("b", "x"), ("", "1970")], "travailleur_id string, annee_naissance string")
    definition = {"name": "c", "reference_year": 2026, "population": {"min_age": 10, "region": "x"}}
    result = evaluate_cohort(spark, {"travailleur": workers}, definition)
    summary = result.summary.first()
    assert summary["feasibility_status"] == "not_feasible" and summary["source_population_count"] == 2
    assert summary["missing_tables"] == "episode_poste,etablissement"
    assert [r["id"] for r in result.steps.collect()] == ["source_population"]
    assert result.included.count() == 0
    assert {r["code"] for r in result.diagnostics.collect()} == {"missing_table"}

    result = evaluate_cohort(spark, {"travailleur": workers}, {"reference_year": 2026, "population": {"min_age": 100}}, materialize=True)
    assert result.summary.first()["feasibility_status"] == "feasible_empty"
    assert [(r["input_count"], r["output_count"]) for r in result.steps.orderBy("ord").collect()] == [(None, 2), (2, 0)]
    result.save(str(tmp_path / "result"))
    assert spark.read.parquet(str(tmp_path / "result/steps")).count() == 2
    with pytest.raises(ValueError):
        evaluate_cohort(spark, {"travailleur": workers}, {"population": {"min_age": 1}})
