"""Run registered queries and their SQL side by side: ``python tests/oracle_check.py SF_DIR [key…]``."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((v is None, str(type(v)), v) for v in r)
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=key)


def compare(spark: SparkSession, con, sf_dir: str, query, sql: str) -> str | None:
    """None when names and values agree, else what differs."""
    df = query(spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{g} != {w}"
    return None if got else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir, keys = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracle = entry.oracle_sql()
    for name, query in entry.queries().items():
        if keys and name not in keys:
            continue
        t = time.time()
        try:
            problem = compare(spark, con, sf_dir, query, oracle[name]) if name in oracle else "-"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:32s} {time.time() - t:6.2f}s {'ok' if problem is None else problem}", flush=True)
