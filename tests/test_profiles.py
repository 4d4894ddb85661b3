"""Ranked values of a column."""

from pyspark.sql import functions as F

from harmonia.operators import profiling
from harmonia.operators.profiling import infer_entities
from harmonia.sources.exports import SourceTable


def test_values_of_one_row_number_are_ranked_by_their_text(spark):
    long = "x" * 70
    values = [f"{k * 37 % 50:02d}" for k in range(50)] + [long]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(7)
    counts = profiling.value_counts([SourceTable.from_dataframe("s", df, F.lit(1))])
    wanted = sorted(values)
    for ranked, n in ((profiling.first_examples, 3), (profiling.top_values, 8)):
        found = ranked(counts, n).orderBy("rank").collect()
        assert [r["value"] for r in found] == wanted[:n]
    assert profiling.first_examples(counts, 51).where("rank = 51").first()["value"] == long


def test_names_are_folded_once_for_all_words(spark):
    """The folding of a source's name does not grow with the words that are looked for in it."""
    table = spark.createDataFrame([("Salariés.csv", "x"), ("a.csv", "cleperssite"), (None, None)], "file string, names string")
    found = table.select(infer_entities(F.col("file"), F.col("names")).alias("entities"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
    rows = [r["entities"] for r in found.collect()]
    assert rows[0] == ["travailleur", "episode_poste", "unite_travail"]
    assert rows[1] == ["episode_poste"] and rows[2] == []


def test_counts_and_columns_are_computed_once_for_all_that_reads_them(spark):
    table = SourceTable.from_dataframe("s", spark.createDataFrame([("a",), ("b",)], "v string"), F.lit(1))
    profiles = profiling.profile(spark, [table])
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (profiles.columns, profiles.sources)]
    assert "Aggregate" not in plans[0] and "Generate" not in plans[1] and "Window" not in plans[1]
    assert profiles.columns.first()["row_count"] == 2 and profiles.sources.first()["row_count"] == 2


def test_both_choices_of_a_review_share_one_draft(spark, monkeypatch):
    from suite import decisions

    calls, profiled = [], decisions.profiled
    monkeypatch.setattr(decisions, "profiled", lambda *given: calls.append(given) or profiled(*given))
    rows = decisions.review_left(spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == 1 and {r["rejected_ones"] for r in rows} <= {"kept", "dropped"}
