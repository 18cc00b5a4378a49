"""Run bound queries on Spark and their SQL twins on DuckDB and compare rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value.is_integer() else round(value, 9)
    if isinstance(value, bool):
        return value
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(spark, con, job, sql: str, folder: str) -> str | None:
    frame = job(spark, folder)
    columns = sorted(frame.columns)
    left = Counter(tuple(plain(row[c]) for c in columns) for row in frame.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns differ: {columns} / {sorted(names)}"
    index = [names.index(c) for c in columns]
    right = Counter(tuple(plain(row[i]) for i in index) for row in cursor.fetchall())
    if not left:
        print("   (no rows)", end=" ")
    if left != right:
        a, b = list((left - right).items())[:3], list((right - left).items())[:3]
        return f"rows {sum(left.values())}/{sum(right.values())}\n   cols {columns}\n  spark {a}\n  duck  {b}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from loomtrace.session import local_session

    folder = f"/root/testdata/{argv[0]}"
    spark, con = local_session(), duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or list(queries):
        started = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, queries[name], oracles[name], folder)
                note = "same" if problem is None else "DIFFERENT " + problem
            else:
                problem, rows = None, queries[name](spark, folder).collect()
                note = f"rows only: {len(rows)}; first {str(rows[:1])[:300]}"
        except Exception as error:  # report and go on with the next query
            problem, note = "x", "FAILED " + str(error)[:1500]
        bad += problem is not None
        print(f"{name}: {note} ({time.time() - started:.1f}s)", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
