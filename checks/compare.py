"""Run queries in Spark and their SQL in DuckDB on the same files and compare the results.

python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from opsloom.session import local_session


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, Decimal):
        return float(value)
    return value


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(out, key=repr)


# Spark type names by DuckDB type name
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "BLOB": "binary",
}


def compare(spark, con, folder: str, name: str) -> list[str]:
    start = time.time()
    df = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    problems = []
    if name not in ORACLE:
        print(f"{name}: {len(rows)} rows, no SQL, {took:.2f}s")
        return problems
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    if sorted(columns) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(columns)}")
    else:
        for column, kind in df.dtypes:
            if kind != types[column]:
                problems.append(f"type of {column}: {kind} vs {types[column]}")
        a, b = sorted_rows(df.columns, rows), sorted_rows(columns, expected)
        if len(a) != len(b):
            problems.append(f"{len(a)} rows vs {len(b)}")
        different = [(x, y) for x, y in zip(a, b) if x != y]
        if different:
            problems.append(f"{len(different)} rows differ, first {different[0]}")
    print(f"{name}: {len(rows)} rows, {took:.2f}s {'ok' if not problems else problems}", flush=True)
    return problems


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark, con = local_session(), duck(folder)
    failed = 0
    for name in names:
        try:
            failed += bool(compare(spark, con, folder, name))
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            failed += 1
            print(f"{name}: FAILED {type(error).__name__}: {str(error)[:1500]}", flush=True)
    print(f"{len(names) - failed} of {len(names)} fine")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
