"""Registered queries over the smallest given tables, and the pipeline."""

import zlib

import pytest

import corpus_pipeline
from harmonia.llm import near_dedup, packing, pii, quality, queries
from tests.llm import fixtures as fx
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    _, problem, _, _ = compare(spark, connect(SMALL), SMALL, queries.QUERIES[name], queries.SQL[name])
    assert problem is None, problem


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_sharding", "op5_pii", "op12_exact_dedup"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for operator in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_held_out_accuracy(spark):
    found = queries.QUERIES["op6_language"](spark, "/root/testdata/sf0.01").where("held_out")
    rows = found.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)


def test_pipeline_against_plain_python(spark):
    """Every stage against its plain version, on what the stage before has kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    model = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    verdict = {r.doc_id: r.kept for r in quality.score(docs, model).collect()}
    left = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SMALL)
        if name == "quality_rules":
            left = {i: t for i, t in left.items() if verdict[i]}
            assert all(not fx.base_quality(t)[-1] for t in left.values()) and left
        elif name == "near_dedup":
            left = {i: left[i] for i, (_, root) in fx.near_groups(left).items() if i == root}
        elif name == "decontamination":
            left = {r[0]: left[r[0]] for r in fx.contamination(list(left.items()), items) if not r[-1]}
        elif name == "pii":
            rows = found.collect()
            assert {r.doc_id for r in rows} == set(left)
            for r in rows:
                assert fx.personal_data(r.text)[:4] == (0, 0, 0, 0) and r.n_chars == len(r.text)
                assert r.text == left[r.doc_id] or pii.BASE_KINDS and "[" in r.text
            left = {r.doc_id: r.text for r in rows}
        if name != "packing":
            assert found.columns == docs.columns and {r.doc_id: r.text for r in found.collect()} == left
            docs = found
    run = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in run} == set(left)
    assert sorted(r[:5] for r in run) == sorted(r[:5] for r in packing.pack(docs).collect())


def test_pipeline_with_awkward_rows(spark, tmp_path):
    fx.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(1, 20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(fx.prose(999, 60)[5:25]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(1, 13)) <= kept and not any(r in kept for r in (13, 14))
