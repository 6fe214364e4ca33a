"""Run registered queries in Spark and in DuckDB and compare them: python -m checks.compare SF_DIR [names]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con




def fingerprint(columns, rows):
    """Column names in order, and rows sorted as text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def compare(spark, con, folder: str, query, sql: str):
    begun = time.time()
    df = query(spark, folder)
    got = fingerprint(df.columns, df.collect())
    spent = time.time() - begun
    cursor = con.execute(sql)
    wanted = fingerprint([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != wanted[0]:
        return f"columns {got[0]} / {wanted[0]}", spent
    if len(got[1]) != len(wanted[1]):
        return f"rows {len(got[1])} / {len(wanted[1])}", spent
    differing = [(a, b) for a, b in zip(got[1], wanted[1]) if repr(a) != repr(b)]
    if differing:
        return f"{len(differing)} of {len(got[1])} rows differ, e.g. {differing[0]}", spent
    return f"ok {len(got[1])} rows", spent


def main() -> None:
    from checks import oracle, registry
    from paneldrift.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(folder)
    queries, sqls = registry.queries(), oracle.statements()
    bad = 0
    for name in names or queries:
        if name not in sqls:
            begun = time.time()
            rows = len(queries[name](spark, folder).collect())
            print(f"{name}: no SQL, {rows} rows, {time.time() - begun:.2f}s", flush=True)
            continue
        try:
            result, spent = compare(spark, con, folder, queries[name], sqls[name])
        except Exception as error:  # report and go on with the next query
            result, spent = f"ERROR {type(error).__name__}: {str(error)[:400]}", 0.0
        bad += not result.startswith("ok")
        print(f"{name}: {result} {spent:.2f}s", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
