"""Run a registered query in Spark and its SQL twin in DuckDB; compare.

Mirrors the driver's check: row count, column names, and the multiset of
rows (columns sorted by name, values normalised), order-insensitive.

    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(base, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == int(v) and abs(v) < 2**53:
            return int(v)
        return repr(v)
    if isinstance(v, int):
        return v
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, base: str, name: str, con=None) -> dict:
    import __spark_entry__ as E

    con = con or duck(base)
    t0 = time.time()
    sdf = E.queries()[name](spark, base)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(E.oracle_sql()[name])
    dcols = rel.columns
    drows = rel.fetchall()
    t2 = time.time()
    scols = sdf.columns
    res = {
        "name": name,
        "spark_rows": len(srows),
        "oracle_rows": len(drows),
        "columns_match": sorted(scols) == sorted(dcols),
        "spark_sec": round(t1 - t0, 2),
        "oracle_sec": round(t2 - t1, 2),
    }
    if res["columns_match"]:
        a, b = _rows(scols, srows), _rows(dcols, drows)
        res["values_match"] = a == b
        if a != b:
            res["only_spark"] = list((a - b).items())[:3]
            res["only_oracle"] = list((b - a).items())[:3]
    else:
        res["values_match"] = False
        res["spark_cols"], res["oracle_cols"] = scols, dcols
    return res


def main(argv):
    from corpusterms.session import local_session
    import __spark_entry__ as E

    base = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(E.queries())
    spark = local_session(8)
    con = duck(base)
    bad = 0
    for n in names:
        if n not in E.oracle_sql():
            print(f"{n:28s} (no oracle)")
            continue
        r = compare(spark, base, n, con)
        ok = r["values_match"] and r["spark_rows"] == r["oracle_rows"]
        bad += not ok
        print(f"{n:28s} {'OK ' if ok else 'BAD'} rows {r['spark_rows']}/{r['oracle_rows']} "
              f"spark {r['spark_sec']}s duck {r['oracle_sec']}s"
              + ("" if ok else f"\n    {r}"))
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
