"""Compare registered queries with their SQL twins; usable as a script.

    python tests/oracle.py 0.01 a01 e19      # scale factor, then name prefixes
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
ROOT = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/sf{sf}/{name}.parquet'")
    return con


def canonical(value: object) -> object:
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, canonical(v)) for k, v in value.items()))
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(canonical(row[i]) for i in order)) for row in rows)


def compare(spark, con, name: str, fn, sql: str | None, sf: str) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, f"{ROOT}/sf{sf}")
    got = [tuple(x) for x in df.collect()]
    took = time.time() - started
    if sql is None:
        return True, f"{len(got)} rows, no SQL twin, {took:.1f}s"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns differ: {sorted(df.columns)} vs {sorted(columns)}"
    for d in result.description:
        kind, field = str(d[1]).upper(), df.schema[d[0]].dataType.typeName()
        if kind == "HUGEINT" or kind.startswith("DECIMAL"):
            return False, f"column {d[0]} is {kind} in SQL"
        groups = (("INTEGER", "BIGINT", "SMALLINT", "TINYINT", "UINTEGER", "UBIGINT"), ("DOUBLE", "FLOAT"), ("VARCHAR",), ("BOOLEAN",))
        spark_groups = (("integer", "long", "short", "byte"), ("double", "float"), ("string",), ("boolean",))
        for sql_types, spark_types in zip(groups, spark_groups, strict=True):
            if (kind in sql_types) != (field in spark_types):
                return False, f"column {d[0]} is {field} against {kind}"
    mine, theirs = rows_of(df.columns, got), rows_of(columns, want)
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return False, (
            f"{len(mine)} vs {len(theirs)} rows; columns {sorted(columns)}\n   mine only {sorted(a - b)[:2]}"
            f"\n   sql only  {sorted(b - a)[:2]} ({len(a - b)} differ)"
        )
    return True, f"{len(mine)} rows match, {took:.1f}s"


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import build_session

    sf, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = build_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls, bad, total = oracle_sql(), 0, 0
    for name, fn in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        total += 1
        try:
            ok, note = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as error:  # report and go on
            ok, note = False, str(error)[:900]
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
    print(f"{total - bad}/{total} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
