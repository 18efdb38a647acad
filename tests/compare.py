"""Run queries and their SQL side by side: python -m tests.compare [sf_dir] [name...]"""

import math
import os
import sys
import time
from pathlib import Path

import duckdb

import __spark_entry__ as entry
from siltstone.runtime import release, session


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def database(at):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(at).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    return con


def compare(spark, at, name):
    """(rows, rows of the SQL, equal) of one query."""
    df = entry.queries()[name](spark, at)
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), None, None
    cur = database(at).execute(sql)
    columns = [c[0] for c in cur.description]
    want = rows_of(columns, cur.fetchall())
    return len(got), len(want), got == want and sorted(columns) == sorted(df.columns)


if __name__ == "__main__":
    at = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session(os.environ.get("CORES", "8"))
    for name in sys.argv[2:] or entry.queries():
        t = time.time()
        try:
            print(name, *compare(spark, at, name), f"{time.time() - t:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            print(name, "FAILED", str(e)[:600], flush=True)
        release(spark)
