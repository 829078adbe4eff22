"""Run registered queries in Spark and their SQL in DuckDB and compare them exactly.

    python tests/oracle_check.py <folder> [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, folder, name, fn, sql):
    df = fn(spark, folder)
    cols, got = rows_of(df.columns, df.collect())
    if sql is None:
        return len(got), None
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(sql)
    ocols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return len(got), f"columns differ: {cols} / {ocols}"
    if len(got) != len(want):
        return len(got), f"rows differ: {len(got)} / {len(want)}; e.g. {sorted(set(got) - set(want), key=repr)[:2]} / {sorted(set(want) - set(got), key=repr)[:2]}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return len(got), f"{len(bad)} rows differ, first: {bad[0]}"
    kinds = [type(v).__name__ for v in got[0]] if got else []
    wkinds = [type(v).__name__ for v in want[0]] if want else []
    return len(got), None if kinds == wkinds else f"types differ: {kinds} / {wkinds}"


def main():
    import __spark_entry__ as entry
    from surveyloom.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle-check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            n, problem = compare(spark, folder, name, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001
            n, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        mark = "FAIL" if problem else ("ok" if name in oracle else "rows")
        print(f"{mark:5}{name:32}{n:8} rows {time.time() - start:6.2f} s  {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
