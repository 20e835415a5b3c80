"""Run registered queries on Spark and their SQL on DuckDB, and compare whole results.

``python -m tests.oracle [--sf DIR] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import argparse
import math
import re
import tempfile
import time
from pathlib import Path

import duckdb

from coursecast.plans.registry import REGISTRY
from coursecast.session import session


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value if value is None or isinstance(value, (int, bool, str)) else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


# Spark type name -> DuckDB type name, for the schema part of the comparison.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


# What no plan of this repository should hold, whatever the data.
UNWANTED = {
    "cross join": r"CartesianProduct|BroadcastNestedLoopJoin",
    "Python in the plan": r"PythonUDF|EvalPython|InPandas|InArrow|PythonRDD",
    "window over the whole table": r"Window [^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition",
}


def plan_problems(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [problem for problem, pattern in UNWANTED.items() if re.search(pattern, plan)]


def compare(spark, db, name: str, sf_dir: str) -> tuple[list[str], int, float]:
    """(differences, rows, seconds) of one query."""
    query = REGISTRY[name]
    start = time.time()
    df = query.build(spark, sf_dir)
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    problems = plan_problems(df)
    if query.sql is None:
        return problems + ([] if got else ["no rows"]), len(got), seconds
    result = db.execute(query.sql)
    want_columns = [d[0] for d in result.description]
    want_types = {d[0]: str(d[1]) for d in result.description}
    a_columns, a = _rows(got_columns, got)
    b_columns, b = _rows(want_columns, result.fetchall())
    if a_columns != b_columns:
        return [f"columns {a_columns} != {b_columns}"], len(got), seconds
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    differing = [(x, y) for x, y in zip(a, b) if x != y]
    if differing:
        problems.append(f"{len(differing)} rows differ, first {differing[0]}")
    for column, kind in df.dtypes:
        if TYPES.get(kind, kind) != want_types[column]:
            problems.append(f"type of {column}: {kind} != {want_types[column]}")
    return problems, len(got), seconds


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    failed = 0
    with tempfile.TemporaryDirectory(prefix="coursecast-") as scratch:
        spark = session(
            "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
            spark__driver__memory="8g", spark__checkpoint__dir=scratch,
        )
        spark.sparkContext.setLogLevel("ERROR")
        db = duck(options.sf)
        for name in options.names or REGISTRY:
            try:
                problems, rows, seconds = compare(spark, db, name, options.sf)
            except Exception as error:  # shown with the query it belongs to
                problems, rows, seconds = [f"{type(error).__name__}: {str(error)[:600]}"], 0, 0.0
            failed += bool(problems)
            mark = "FAIL" if problems else "rows" if REGISTRY[name].sql is None else "ok"
            print(f"{mark:5} {name:34} {rows:7} rows {seconds:6.2f}s  {'; '.join(problems)}", flush=True)
        spark.stop()
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
