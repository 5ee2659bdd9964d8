"""Compare registered queries with their SQL over one folder of test tables.

    python tests/oracle_check.py [folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str):
    """A DuckDB connection with the test tables as views."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    """Comparable form of a cell."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return int(value) if value == int(value) and abs(value) < 1e15 else value
    if isinstance(value, (int, str)):
        return value
    if hasattr(value, "as_tuple"):
        return plain(float(value))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, folder: str, name: str, query, sql: str) -> str | None:
    """None when both sides have equal columns and rows, else what differs first."""
    df = query(spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{str(a)[:400]} against {str(b)[:400]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from cohort.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(queries())
    spark, con = local_session(8), database(folder)
    bad = 0
    for name in wanted:
        start = time.time()
        sql = oracle_sql().get(name)
        try:
            if sql is None:
                result = f"rows only: {queries()[name](spark, folder).count()}"
            else:
                found = difference(spark, con, folder, name, queries()[name], sql)
                bad += found is not None
                result = f"DIFFERS: {found}" if found else "equal"
        except Exception as e:  # noqa: BLE001 - report and go on
            bad += 1
            result = f"FAILS: {str(e)[:700]}"
        print(f"{name:28s} {time.time() - start:6.1f} s  {result}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
