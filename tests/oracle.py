"""Compare registered queries with their SQL, run by DuckDB on the same files.

    python tests/oracle.py [name ...] [--sf DIR]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in value.asDict().items())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, sf_dir, build, sql):
    """(rows, difference or None, Spark seconds, SQL seconds)."""
    started = time.time()
    df = build(spark, sf_dir)
    got_columns, got = df.columns, df.collect()
    middle = time.time()
    if sql is None:
        return len(got), None, middle - started, 0.0
    cursor = con.execute(sql)
    want_columns, want = [d[0] for d in cursor.description], cursor.fetchall()
    ended = time.time()
    problem = None
    if sorted(got_columns) != sorted(want_columns):
        problem = f"columns {sorted(got_columns)} vs {sorted(want_columns)}"
    else:
        left, right = rows_of(got_columns, got), rows_of(want_columns, want)
        if left != right:
            pairs = [(a, b) for a, b in zip(left, right, strict=False) if a != b][:3]
            problem = f"{len(left)} vs {len(right)} rows; {pairs} {sorted(got_columns)}"
    return len(got), problem, middle - started, ended - middle


def main():
    import __spark_entry__ as entry
    from harmonia.session import build_session

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf_dir = args[at + 1]
        del args[at:at + 2]
    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, build in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            count, problem, spark_s, sql_s = compare(spark, con, sf_dir, build, oracle.get(name))
        except Exception as error:  # report every query
            count, problem, spark_s, sql_s = 0, f"{type(error).__name__}: {str(error)[:1500]}", 0, 0
        failed += problem is not None
        note = "" if name in oracle else " (no SQL)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{note}: {count} rows, spark {spark_s:.2f}s, sql {sql_s:.2f}s"
              + (f"\n     {problem}" if problem else ""), flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
