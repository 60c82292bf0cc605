"""Run a registered query and its SQL side by side.

    python -m tests.oracle [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else (0.0 if v == 0 else v)
    return v


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    cols = sorted(df.columns)
    got = Counter(
        tuple(_plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in cols]).collect()
    )
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return f"columns differ: {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = Counter(tuple(_plain(row[i]) for i in order) for row in cur.fetchall())
    if got == want:
        types = {n: str(t) for n, t in zip(names, [c[1] for c in cur.description])}
        bad = [f"{c}:{types[c]}" for c in cols if types[c].startswith(("HUGEINT", "DECIMAL"))]
        return f"types: {bad}" if bad else None
    only_got, only_want = got - want, want - got
    return (
        f"{sum(got.values())} against {sum(want.values())} rows, {sum(only_got.values())} differ, columns {cols}\n"
        f"   spark {list(only_got)[:3]}\n   sql   {list(only_want)[:3]}"
    )


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in chosen:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                print(f"rows  {name}: {df.count()}  {time.time() - start:.1f}s", flush=True)
                df.show(4, truncate=60)
            else:
                diff = compare(df, con, sql)
                print(f"{'ok   ' if diff is None else 'FAIL '} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
        except Exception as e:  # report and go on with the next query
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
