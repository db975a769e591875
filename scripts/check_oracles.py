"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python scripts/check_oracles.py [sf_dir] [name ...]
Prints one line per query: rows, column-set match and value match.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, ".")
from millwright.plans import catalog  # noqa: E402
from millwright.session import local_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 4)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(records, cols):
    out = [tuple(norm(r[c]) for c in cols) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    catalog.load_all()
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in names or sorted(catalog.QUERIES):
        t0 = time.time()
        try:
            sdf = catalog.QUERIES[name](spark, sf)
            srows = [r.asDict() for r in sdf.collect()]
            scols = sorted(sdf.columns)
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK-ERROR {str(e)[:300]}")
            bad += 1
            continue
        dt = time.time() - t0
        sql = catalog.ORACLES.get(name)
        if sql is None:
            print(f"{name:32s} rows={len(srows):7d} (no oracle) {dt:.1f}s")
            continue
        try:
            rel = con.execute(sql)
            dcols = [d[0] for d in rel.description]
            drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} DUCK-ERROR {str(e)[:300]}")
            bad += 1
            continue
        colok = sorted(dcols) == scols
        valok = colok and rows_of(srows, scols) == rows_of(drows, scols)
        flag = "OK " if (colok and valok and len(srows) == len(drows)) else "BAD"
        if flag == "BAD":
            bad += 1
        print(f"{name:32s} {flag} spark={len(srows)} duck={len(drows)} cols={'ok' if colok else (scols, sorted(dcols))} {dt:.1f}s")
        if flag == "BAD" and colok:
            a, b = rows_of(srows, scols), rows_of(drows, scols)
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            print("   cols", scols)
            for x, y in diff:
                print("   spark", x)
                print("   duck ", y)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
