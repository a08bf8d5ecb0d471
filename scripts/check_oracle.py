"""Run registered Spark queries and their DuckDB oracles side by side.

usage: python scripts/check_oracle.py [sf_dir] [name ...]
Prints per query: rows (spark/duckdb), column match, and value match
(order-insensitive, columns sorted by name).
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from revcast.plans.registry import REGISTRY  # noqa: E402
from revcast.session import local_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


EXACT = os.environ.get("CHECK_EXACT") == "1"


def norm(v):
    if isinstance(v, float):
        return v + 0.0 if EXACT else round(v, 6) + 0.0
    if hasattr(v, "as_tuple") and not isinstance(v, (int, float)):   # Decimal from DuckDB
        return float(v)
    return v


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)] or list(REGISTRY)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    spark = local_session(8)
    bad = 0
    for name in names:
        q = REGISTRY[name]
        t0 = time.time()
        try:
            sdf = q.spark(spark, sf)
            cols = sorted(sdf.columns)
            srows = [tuple(norm(r[c]) for c in cols) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"{name:32s} rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.sql(q.sql)
            dcols = rel.columns
            drows_raw = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} DUCKDB ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        idx = [dcols.index(c) if c in dcols else None for c in cols]
        colmatch = sorted(dcols) == cols
        drows = [tuple(norm(r[i]) if i is not None else None for i in idx) for r in drows_raw]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        ok = colmatch and sorted(srows, key=key) == sorted(drows, key=key)
        if not ok:
            bad += 1
            sset, dset = set(srows), set(drows)
            print(f"{name:32s} MISMATCH rows={len(srows)}/{len(drows)} cols={colmatch} "
                  f"only_spark={len(sset - dset)} only_duck={len(dset - sset)}")
            if not colmatch:
                print("   spark:", cols, "\n   duck: ", sorted(dcols))
            for r in list(sset - dset)[:3]:
                print("   S", r)
            for r in list(dset - sset)[:3]:
                print("   D", r)
        else:
            print(f"{name:32s} ok rows={len(srows)} {ts:.1f}s")
    print("bad:", bad)


if __name__ == "__main__":
    main()
