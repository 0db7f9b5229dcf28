"""Run registered Spark queries and their DuckDB oracle SQL side by side.

    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]

Compares column names (sorted), row count, column kinds and the multiset of
rows.  Used by tests/test_oracle.py and by hand while developing.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return ("n",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("f", "nan")
        return ("f", v)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, float):  # Decimal
        return ("d", str(v))
    return ("s", str(v))


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    problems = []
    if sorted(spark_cols) != sorted(duck_cols):
        problems.append(f"columns differ: spark={sorted(spark_cols)} duck={sorted(duck_cols)}")
        return problems
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in spark_rows), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in duck_rows), key=repr)
    if len(a) != len(b):
        problems.append(f"row count spark={len(a)} duck={len(b)}")
    kinds_a = {c: {x[k][0] for x in a} - {"n"} for k, c in enumerate(order)}
    kinds_b = {c: {x[k][0] for x in b} - {"n"} for k, c in enumerate(order)}
    for c in order:
        if kinds_a[c] and kinds_b[c] and kinds_a[c] != kinds_b[c]:
            problems.append(f"kind of {c}: spark={kinds_a[c]} duck={kinds_b[c]}")
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems


def run(sf_dir: str, names=None, spark=None):
    from txrisk.catalog import ORACLE, QUERIES
    from txrisk.session import get_spark

    spark = spark or get_spark(master="local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    results = {}
    for name in names or list(QUERIES):
        t = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # report and go on with the next query
            results[name] = ([f"spark error: {str(e)[:400]}"], 0, time.time() - t)
            continue
        ts = time.time() - t
        if name not in ORACLE:
            results[name] = (None, len(rows), ts)
            continue
        try:
            cur = con.execute(ORACLE[name])
        except Exception as e:
            results[name] = ([f"duckdb error: {str(e)[:400]}"], len(rows), ts)
            continue
        dcols = [d[0] for d in cur.description]
        drows = cur.fetchall()
        results[name] = (compare(rows, df.columns, drows, dcols), len(rows), ts)
    return results


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    res = run(sf, sys.argv[2:] or None)
    bad = 0
    for k, (probs, n, ts) in res.items():
        status = "ROWS-ONLY" if probs is None else ("OK" if not probs else "FAIL")
        bad += status == "FAIL"
        print(f"{status:9s} {k:32s} rows={n:<7d} {ts:6.2f}s {'' if not probs else probs}")
    sys.exit(1 if bad else 0)
