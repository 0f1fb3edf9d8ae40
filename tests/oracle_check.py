"""Compare registered queries with their SQL: rows, columns, types, values.

Run as a script: ``python tests/oracle_check.py [sf_dir] [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'"
        )
    return connection


def _key(row):
    return tuple((value is None, str(type(value)), value) for value in row)


def _plain(table):
    names = sorted(table.column_names)
    columns = [table.column(name).to_pylist() for name in names]
    rows = [
        tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row)
        for row in zip(*columns, strict=True)
    ]
    return names, sorted(rows, key=_key)


def _types(table):
    return {f.name: str(f.type).replace("large_", "").split("[")[0] for f in table.schema}


def differences(spark, connection, query, sql, sf_dir) -> list[str]:
    """What differs between the query and the SQL, empty if nothing does."""
    mine = query(spark, sf_dir).toArrow()
    theirs = connection.sql(sql).to_arrow_table()
    problems = []
    my_names, my_rows = _plain(mine)
    names, rows = _plain(theirs)
    if my_names != names:
        return [f"columns {my_names} against {names}"]
    if _types(mine) != _types(theirs):
        wrong = {
            k: (v, _types(theirs)[k]) for k, v in _types(mine).items() if _types(theirs)[k] != v
        }
        problems.append(f"types {wrong}")
    if len(my_rows) != len(rows):
        problems.append(f"{len(my_rows)} rows against {len(rows)}")
    wrong = [(a, b) for a, b in zip(my_rows, rows) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    if not rows:
        problems.append("no rows")
    return problems


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from heliodrift.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(queries())
    spark, connection = local_session(), connect(sf_dir)
    failed = 0
    for name in chosen:
        start = time.time()
        try:
            if name in oracle_sql():
                found = differences(
                    spark, connection, queries()[name], oracle_sql()[name], sf_dir
                )
            else:
                found = [] if queries()[name](spark, sf_dir).count() else ["no rows"]
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok':4} {name} {time.time() - start:.1f}s", *found, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
