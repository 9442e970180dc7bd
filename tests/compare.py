"""Run registered queries next to their SQL twins. Usage: python tests/compare.py FOLDER [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN!"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(spark, con, folder, function, sql):
    """Returns (problem or None, spark row count)."""
    df = function(spark, folder)
    got = df.collect()
    if sql is None:
        return (None if got else "no rows and no SQL to say so"), len(got)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(got)
    left, right = rows_of(df.columns, got), rows_of(names, expected)
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}: {left[:2]} {right[:2]}", len(got)
    if left != right:
        different = [(a, b) for a, b in zip(left, right) if a != b]
        return f"{len(different)} rows differ, first {different[0]}", len(got)
    return None, len(got)


if __name__ == "__main__":
    import __spark_entry__ as contract
    from hazegrid.session import build_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(cpus=os.environ.get("COMPARE_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = contract.oracle_sql()
    bad = 0
    for name, function in contract.queries().items():
        if wanted and not any(name == w or name.startswith(w + "_") for w in wanted):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, folder, function, oracles.get(name))
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {kind:4s} {n:7d} rows {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print("failures:", bad)
    sys.exit(bool(bad))
