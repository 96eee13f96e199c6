"""Compare registered queries with their DuckDB checks: `python tests/compare.py SF_DIR [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return con


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    types = dict(zip(names, [str(c[1]) for c in cur.description]))
    expected = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns: only spark {sorted(set(df.columns) - set(names))}, only check {sorted(set(names) - set(df.columns))}"
    order = sorted(names)
    kinds = dict(df.dtypes)
    bad = [(c, kinds[c], types[c]) for c in order if _KINDS.get(kinds[c], kinds[c]) != types[c] and types[c] != '"NULL"']
    if bad:
        return f"types: {bad}"
    pos = [names.index(c) for c in order]
    want = sorted((tuple(_norm(r[i]) for i in pos) for r in expected), key=_key)
    got = sorted((tuple(_norm(r[c]) for c in order) for r in df.collect()), key=_key)
    if len(want) != len(got):
        return f"rows: spark {len(got)}, check {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            diff = [(c, a, b) for c, a, b in zip(order, g, w) if a != b]
            return f"values: {diff[:6]} in {dict(zip(order, g))}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = compare(df, con, checks[name]) if name in checks else f"no check, {df.count()} rows"
            n = df.count() if problem is None else 0
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:40s} {n:8d} rows {time.time() - start:6.2f}s"
              f"{'' if problem is None else '  ' + problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
