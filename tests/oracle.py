"""Comparing a query with its SQL in DuckDB; also runs by hand: python -m tests.oracle FOLDER NAME..."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x: object) -> object:
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows(names: list[str], data: list) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    got = rows(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only in Spark {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from tidelog.session import local_session

    spark = local_session(os.environ.get("CORES", "8"))
    con, queries, sql = connect(sys.argv[1]), e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            df = queries[name](spark, sys.argv[1])
            said = difference(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    sys.exit(bool(bad))
