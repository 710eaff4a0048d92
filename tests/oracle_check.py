"""Run registered queries next to their oracle SQL and compare whole results.

    python tests/oracle_check.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle_connection(folder: str):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def canonical_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def compare(query, sql: str, spark, connection, folder: str) -> str | None:
    """None when both sides agree, otherwise what differs."""
    frame = query(spark, folder)
    columns = frame.columns
    ours = canonical_rows(columns, [tuple(r) for r in frame.collect()])
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = canonical_rows(names, cursor.fetchall())
    if sorted(columns) != sorted(names):
        return f"columns {sorted(columns)} vs {sorted(names)}"
    if ours != theirs:
        left = [r for r in ours if r not in set(theirs)][:3]
        right = [r for r in theirs if r not in set(ours)][:3]
        return f"rows {len(ours)} vs {len(theirs)}; only ours {left}; only oracle {right}"
    return None if ours else "both sides are empty"


def main() -> int:
    import __spark_entry__ as entry
    from wardlog.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, connection = local_session(8), oracle_connection(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failures = 0
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(query, oracles[name], spark, connection, folder)
            else:
                problem = f"no oracle, {query(spark, folder).count()} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None and not problem.startswith("no oracle")
        print(f"{'FAIL' if problem and not problem.startswith('no oracle') else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main())
