"""Run registered queries on Spark and their SQL on DuckDB; compare results.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key_of(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def duck_connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for name in RAW:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    raw = df.collect()
    rows = [tuple(norm(v) for v in r) for r in raw]
    t1 = time.time()
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    oraw = res.fetchall()
    orows = [tuple(norm(v) for v in r) for r in oraw]
    problems = []
    # The same Python value types on both sides (a value hash would tell
    # 1 from 1.0 or Decimal('1')).
    for i, c in enumerate(cols):
        if c not in ocols:
            continue
        j = ocols.index(c)
        st = {type(r[i]).__name__ for r in raw if r[i] is not None}
        ot = {type(r[j]).__name__ for r in oraw if r[j] is not None}
        if st and ot and st != ot:
            problems.append(f"types of {c}: spark={st} oracle={ot}")
    if sorted(cols) != sorted(ocols):
        problems.append(f"columns spark={cols} oracle={ocols}")
        return problems, len(rows), len(orows), t1 - t0
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
    a = sorted((tuple(r[i] for i in order) for r in rows), key=key_of)
    b = sorted((tuple(r[i] for i in oorder) for r in orows), key=key_of)
    if len(a) != len(b):
        problems.append(f"rows spark={len(a)} oracle={len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        only_a = [r for r in a if r not in sb][:3]
        only_b = [r for r in b if r not in sa][:3]
        names = [cols[i] for i in order]
        problems.append(f"values differ; cols={names}\n  spark-only={only_a}\n  oracle-only={only_b}")
    return problems, len(rows), len(orows), t1 - t0


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    from halyard.session import build_session
    import __spark_entry__ as E
    spark = build_session()
    con = duck_connect(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for key in (keys or list(qs)):
        if key not in sqls:
            df = qs[key](spark, sf_dir)
            n = df.count()
            print(f"NOSQL {key}: {n} rows")
            continue
        try:
            problems, n, m, secs = compare(spark, con, key, qs[key], sqls[key], sf_dir)
        except Exception as exc:  # report and go on
            problems, n, m, secs = [f"error: {str(exc)[:800]}"], -1, -1, 0
        status = "OK  " if not problems else "FAIL"
        bad += bool(problems)
        print(f"{status} {key}: spark={n} oracle={m} ({secs:.1f}s)")
        for p in problems:
            print("     " + p)
    print(f"{len(keys or qs) - bad} ok, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
