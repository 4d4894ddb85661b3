"""Registered queries: every SQL names a query, and plans stay distributed."""

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 60 and set(sql) <= set(queries)
    assert len(entry.entry(spark).columns) == 6


@pytest.mark.parametrize(
    "name", ["cohort_static", "cohort_linked_date", "column_overlaps", "table_episode_poste", "anomaly_table"]
)
def test_plans(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert operator not in plan, operator


@pytest.mark.parametrize("name", [
    "cohort_linked_date", "top_values", "resolve_keys", "registry_snapshots", "coverage_rules", "landed_documents", "table_run_losses", "small_cells",
    "learning_columns", "overlap_values",
])
def test_against_sql(spark, name):
    from tests.oracle import compare, connect

    _, problem, _, _ = compare(spark, connect(SMALL), SMALL, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None, problem


def test_resolution_plans_grow_with_the_rules_only(spark):
    from dataclasses import replace

    from harmonia.operators.key_resolution import JoinContext
    from suite.tables import RULES, context

    made = context(spark, SMALL, ["orders", "nation", "customer"])
    rule = next(r for r in RULES if r.foreign_source == "orders" and r.key_role == "etablissement_id")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", rule.foreign_column]
    scans = []
    for n in (1, 2, 4):
        rules = [replace(rule, id=str(k), foreign_column=columns[k]) for k in range(n)]
        joins = JoinContext(made.sources, rules)
        orders = joins.sources["orders"]
        found = joins.resolve(orders.df, orders, "etablissement_id", None, "site")
        scans.append(found._jdf.queryExecution().sparkPlan().toString().count("FileScan"))
    assert scans[1] - scans[0] <= 6 and scans[2] - scans[1] <= 2 * (scans[1] - scans[0]), scans
    same = JoinContext(made.sources, [replace(rule, id=str(k)) for k in range(4)])
    orders = same.sources["orders"]
    plan = same.resolve(orders.df, orders, "etablissement_id", None, "site")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") <= scans[0] + 6
